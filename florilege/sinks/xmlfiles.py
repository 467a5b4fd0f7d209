"""XML documents written by many tasks, plain or in compressed parts that readers can split at: blocks of .xz, members of .gz."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from florilege.operators.stored import opened, qualified, stored

BLOCK_BYTES = 1 << 20
#: How hard .xz blocks are compressed: files that are written to be read again soon should be quick to write.
PRESET = 0


def _number(value: int) -> bytes:
    """Seven bits a byte, the least first."""
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def _checked(data: bytes) -> bytes:
    return data + zlib.crc32(data).to_bytes(4, "little")


def xz_parts(blocks: Iterator[bytes]) -> Iterator[bytes]:
    """One .xz stream with a block for each of blocks, and the index that tells where they are."""
    records, header = b"", b""
    n = 0
    for block in blocks:
        whole = lzma.compress(block, lzma.FORMAT_XZ, lzma.CHECK_CRC64, PRESET)
        index = 4 * (int.from_bytes(whole[-8:-4], "little") + 1)
        if not n:
            header = whole[:12]
            yield header
        body = whole[12 : -12 - index]
        yield body
        records += _record(whole[-12 - index :])
        n += 1
    if not n:
        yield lzma.compress(b"", lzma.FORMAT_XZ, lzma.CHECK_CRC64)
        return
    index = b"\0" + _number(n) + records
    index = _checked(index + b"\0" * (-len(index) % 4))
    yield index
    said = (len(index) // 4 - 1).to_bytes(4, "little") + header[6:8]
    yield zlib.crc32(said).to_bytes(4, "little") + said + b"YZ"


def _record(index: bytes) -> bytes:
    """Of the index of a stream with one block: its two sizes, which stand behind two bytes."""
    at = 2
    for _ in range(2):
        while index[at] & 0x80:
            at += 1
        at += 1
    return index[2:at]


def gz_parts(blocks: Iterator[bytes]) -> Iterator[bytes]:
    for block in blocks:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        yield squeeze.compress(block) + squeeze.flush()


def _blocks(texts: Iterator[bytes], size: int) -> Iterator[bytes]:
    """Texts in a row, cut every `size` bytes, wherever that is."""
    held = bytearray()
    for text in texts:
        held += text
        while len(held) >= size:
            yield bytes(held[:size])
            del held[:size]
    if held:
        yield bytes(held)


def write(elements: DataFrame, folder: str, suffix: str = "", opening: str = "<root>", closing: str = "</root>", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write a document per task below folder, its elements from the only column; returns (path, bytes, elements).

    suffix: "" for plain files, .xz or .gz. A file's name follows from its task and it appears by a rename, so a task that runs
    again replaces what it wrote.
    """
    folder = qualified(elements.sparkSession, folder)
    parts = {"": lambda blocks: blocks, ".xz": xz_parts, ".gz": gz_parts}[suffix]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, root = opened(folder)
        system.create_dir(root)
        path = f"{root}/part-{context.partitionId():06d}.xml{suffix}"
        n = 0

        def texts() -> Iterator[bytes]:
            nonlocal n
            yield opening.encode()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    if text is not None:
                        n += 1
                        yield text.encode()
            yield closing.encode()

        size = 0
        temporary = f"{root}/_{context.partitionId():06d}.{context.taskAttemptId()}"
        with system.open_output_stream(temporary, compression=None) as out:
            for part in parts(_blocks(texts(), block_bytes)):
                out.write(part)
                size += len(part)
        system.move(temporary, path)
        yield pa.RecordBatch.from_pylist([{"path": path, "bytes": size, "elements": n}])

    return stored(elements.toDF("element").mapInArrow(run, "path string, bytes long, elements long"), "xml-files")
