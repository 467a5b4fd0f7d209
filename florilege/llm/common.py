"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.operators.stored import shared_dir, stored as materialised  # noqa: F401

#: Bytes of text that one vectorised step looks at; longer single texts form a step of their own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(col: str = "doc_id"):
    """The test fold: crc32 of the id's text leaves 2 modulo 4; a null id is training text."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 4 == 2, F.lit(False))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column, nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def fresh(name: str, taken: list[str]) -> str:
    """name, or with underscores added to it, so that no column has it (names differ by more than case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def release() -> None:
    """Give freed memory back to the system: Python workers stay for later stages and would hold it."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    if libc and hasattr(lib := ctypes.CDLL(libc), "malloc_trim"):
        lib.malloc_trim(0)


def chunks(batch: pa.RecordBatch, text: str, size: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about `size` bytes of text and at most `rows` rows each, so that memory doesn't follow the batch."""
    if batch.num_rows == 0:
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows, start + rows)
        yield batch.slice(start, stop - start)
        start = stop
    release()


#: White space of the word rule, and A-Z lowered.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray, letters_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, A-Z lowered, and each text's first place among them.

    Words are what white space separates; with letters_only, what anything but letters, digits and bytes over 127 separates.
    """
    data = _LOWER[data]
    cut = _SPACE[data]
    if letters_only:
        cut = ~(((data >= 97) & (data <= 122)) | ((data >= 48) & (data <= 57)) | (data >= 128))
    word = ~cut
    begin = word.copy()
    begin[1:] &= cut[:-1]
    starts_doc = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[starts_doc] = word[starts_doc]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    # a polynomial of each word's scrambled bytes: letters that aren't in words add nothing
    place = np.arange(len(data), dtype=np.int64)
    run = np.zeros(len(data), np.int64)
    run[starts] = np.diff(starts, prepend=0)
    inside = place - np.cumsum(run)
    longest = int(inside[word].max()) + 1
    powers = np.cumprod(np.full(longest, _BASE | np.uint64(1), np.uint64))
    terms = _SCRAMBLED[data]
    terms[cut] = 0
    terms *= powers[np.minimum(inside, longest - 1)]
    hashes = mix(np.add.reduceat(terms, starts))
    return hashes, np.searchsorted(starts, offsets)


_SCRAMBLED = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
