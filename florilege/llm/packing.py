"""Best-fit packing by a grouping genetic algorithm.

Documents are tokenised, cut where they are longer than a sequence, and the pieces packed into sequences of at most
`capacity` tokens. Pieces are dealt at random into shards of bounded size. Each shard is evolved by several islands, one
Spark group each: a generation injects whole well-filled bins of one parent into another, removes bins that hold a
duplicate, and best-fits the displaced pieces. Between epochs each island gets the elite of its ring neighbour. Bins that
stay badly filled are opened once more and packed together across shards.
"""

from __future__ import annotations

import random
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.llm.common import chunks, materialised

CAPACITY = 4096
END_ID = 1
#: Pieces that one island evolves at most (on average); bounds a task's memory.
SHARD_PIECES = 8192
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 12
POPULATION = 4
#: Bins filled less than this are opened for the round across shards.
REOPEN_BELOW = 0.985
#: Entries of a worker's cache of encoded words; half of them, the most used, outlive a full cache.
CACHE_ENTRIES = 200_000

#: Texts of these characters only are unchanged by NFC and lower-case letter by letter, so their words encode on their own.
_PLAIN = re.compile("[\t\n\r -~À-įı-ȹȻ-ȽȿɀɁ-ɏ]*")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row_id long"

#: Kinds of bytes of a lower-case plain text, as the vocabulary's splitter sees them: runs of letters are words, so are runs of
#: signs, and each digit is one. Bytes that continue a character are of its kind.
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_KINDS = np.full(256, _SIGN, np.uint8)
_KINDS[[0x09, 0x0A, 0x0D, 0x20]] = _SPACE
_KINDS[0x30:0x3A] = _DIGIT
_KINDS[[*range(0x61, 0x7B), *range(0xC3, 0xCB)]] = _LETTER
#: What an apostrophe at a word's begin takes with it.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def split_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in the bytes of lower-case plain texts, each ended by a line end, and which bytes are in words."""
    kind = _KINDS[data]
    inner = np.flatnonzero((data & 0xC0) == 0x80)
    odd = inner[(data[inner - 1] == 0xC3) & ((data[inner] == 0x97) | (data[inner] == 0xB7))]  # the signs of multiplication and division
    kind[odd - 1] = _SIGN
    kind[inner] = kind[inner - 1]
    begin = np.ones(len(data), bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin &= kind != _SPACE
    begin |= kind == _DIGIT
    quote = np.flatnonzero(begin & (data == 0x27))
    for tail in CONTRACTIONS:
        at = quote[quote + len(tail) < len(data) - 1]
        for k, c in enumerate(tail.encode()):
            at = at[data[at + 1 + k] == c]
        begin[at + 1] = False
        after = at + 1 + len(tail)
        begin[after[kind[after] == _LETTER]] = True
    return np.flatnonzero(begin), kind != _SPACE


class Encoder:
    """Exact ids of the tokenizer file.

    Texts that normalisation leaves alone are split into words at once, and each distinct word is encoded once; all others go
    through the library whole.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.entries = entries
        #: Words by number; place and number of each one's ids in flat, and in how many steps it was seen.
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, "<u4")

    def _forget(self) -> None:
        """Keep the most used half of a full cache."""
        least = max(2, int(np.partition(self.uses, -(self.entries // 2))[-(self.entries // 2)]) + 1)
        kept = np.flatnonzero(self.uses >= least)
        names = np.array(list(self.known), object)[kept].tolist()
        self.known = dict(zip(names, range(len(names)), strict=True))
        lengths = self.lengths[kept]
        starts = np.cumsum(lengths) - lengths
        self.flat = self.flat[np.repeat(self.starts[kept] - starts, lengths) + np.arange(int(lengths.sum()))]
        self.starts, self.lengths, self.uses = starts, lengths, self.uses[kept] // 2

    def _learn(self, new: list[str]) -> None:
        letters, tokenize = self.letters, self.model.tokenize
        ids, lengths = array("I"), []
        for word in new:
            own = [t.id for t in tokenize(word if word.isascii() else "".join([letters[b] for b in word.encode()]))]
            ids.extend(own)
            lengths.append(len(own))
        lengths = np.array(lengths, np.int64)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.flat = np.concatenate([self.flat, np.frombuffer(ids, np.uint32).astype("<u4")])

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts, the end id after each."""
        if not texts:
            return []
        lower = [x.lower().encode() for x in texts]
        data = np.frombuffer(b"\n".join([*lower, b""]), np.uint8)
        ends = np.cumsum([len(x) + 1 for x in lower]) - 1
        begin, used = split_words(data)
        offsets = np.append(np.cumsum(used, dtype=np.int32)[begin] - 1, used.sum()).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[used])]).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.known) > self.entries:
            self._forget()
        rows = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(rows < 0)
        if len(unknown):
            rows[unknown] = len(self.known) + np.arange(len(unknown))
            self._learn([distinct[k] for k in unknown.tolist()])
        self.uses[rows] += 1
        codes = rows[np.asarray(coded.indices)]
        last = np.searchsorted(begin, ends)  # so many words come before each text's end
        counts, first = np.insert(self.lengths[codes], last, 1), np.insert(self.starts[codes], last, 0)
        at = np.cumsum(counts) - counts
        where = np.repeat(first - at, counts)
        where += np.arange(len(where))
        ends = at[last + np.arange(len(texts))]  # where each text's end id stands
        where[ends] = 0
        ids = self.flat[where] if len(self.flat) else np.zeros(len(where), "<u4")
        ids[ends] = END_ID
        return np.split(ids, ends[:-1] + 1)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with the end id, as little-endian unsigned 32-bit numbers."""
        plain = [bool(_PLAIN.fullmatch(x)) and "<|" not in x for x in texts]
        quick = iter(self._plain([x for x, p in zip(texts, plain, strict=True) if p]))
        whole = lambda x: np.array([*self.tokenizer.encode(x, add_special_tokens=False).ids, END_ID], "<u4")
        return [next(quick) if p else whole(x) for x, p in zip(texts, plain, strict=True)]


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document; a null text is empty and gives the one id that ends a document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(str(tokenizer_path or _default_tokenizer()))
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in (part for whole in batches for part in chunks(whole, "text")):
            out: list[tuple] = []
            ids = encode(batch.column(1).fill_null("").to_pylist())
            for doc_id, own in zip(batch.column(0).to_pylist(), ids, strict=True):
                for k in range(0, len(own), capacity):
                    part = own[k : k + capacity]
                    out.append((doc_id, k // capacity, k, len(part), zlib.crc32(part.tobytes()), row))
                    row += 1
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row_id"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_fit(order, sizes, bins: list[list[int]], fills: list[int], capacity: int) -> None:
    """Put each item into the fullest bin that takes it, or a new one; changes bins and fills."""
    free = sorted((capacity - f, b) for b, f in enumerate(fills) if f < capacity)
    for item in order:
        size = sizes[item]
        at = bisect_left(free, (size, -1))
        if at == len(free):
            bins.append([item])
            fills.append(size)
            if size < capacity:
                insort(free, (capacity - size, len(bins) - 1))
        else:
            room, b = free.pop(at)
            bins[b].append(item)
            fills[b] += size
            if room > size:
                insort(free, (room - size, b))


def fitness(solution: tuple[list, list]) -> tuple[int, int]:
    """Fewer bins are better, then emptier last ones (a larger sum of squares)."""
    bins, fills = solution
    return len(bins), -sum(f * f for f in fills)


def crossover(a, b, sizes, capacity: int, rng: random.Random):
    """Inject a run of b's best-filled bins into a, drop a's bins that share an item, best-fit what is displaced."""
    bins_b, fills_b = b
    ranked = sorted(range(len(bins_b)), key=lambda k: -fills_b[k])
    whole = sum(1 for f in fills_b if f == capacity)
    injected = ranked[: max(1, rng.randint(max(1, whole // 2), max(1, whole + len(ranked) // 20)))]
    taken = {i for k in injected for i in bins_b[k]}
    bins, fills, displaced = [list(bins_b[k]) for k in injected], [fills_b[k] for k in injected], []
    for content, fill in zip(*a, strict=True):
        if taken.isdisjoint(content):
            bins.append(list(content))
            fills.append(fill)
        else:
            displaced += [i for i in content if i not in taken]
    # mutation: the emptiest bins are opened as well
    for k in sorted(range(len(bins)), key=fills.__getitem__)[: 1 + len(bins) // 50]:
        if fills[k] < capacity:
            displaced += bins[k]
            bins[k], fills[k] = [], 0
    kept = [k for k in range(len(bins)) if bins[k]]
    bins, fills = [bins[k] for k in kept], [fills[k] for k in kept]
    displaced.sort(key=lambda i: -sizes[i])
    best_fit(displaced, sizes, bins, fills, capacity)
    return bins, fills


def seeded(sizes, capacity: int, rng: random.Random, noise: float):
    bins: list[list[int]] = []
    fills: list[int] = []
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 - noise * rng.random()))
    best_fit(order, sizes, bins, fills, capacity)
    return bins, fills


def evolve(sizes: list[int], population: list, capacity: int, generations: int, rng: random.Random):
    """The elite after some generations; the lower bound ends it early."""
    least = -(-sum(sizes) // capacity)
    population = sorted(population, key=fitness)
    for _ in range(generations):
        if len(population[0][0]) == least or len(population) < 2:
            break
        a, b = rng.sample(population[: max(2, len(population) // 2 + 1)], 2)
        population = sorted([*population, crossover(a, b, sizes, capacity, rng)], key=fitness)[: len(population)]
    return population[0]


def _of(bin_of: np.ndarray, sizes: list[int]):
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(bin_of.tolist()):
        bins.setdefault(b, []).append(i)
    return list(bins.values()), [sum(sizes[i] for i in x) for x in bins.values()]


def _numbered(solution, n: int) -> np.ndarray:
    bin_of = np.zeros(n, np.int64)
    for b, content in enumerate(solution[0]):
        bin_of[content] = b
    return bin_of


def evolve_islands(items: DataFrame, level: int, capacity: int, islands: int, epochs: int, generations: int, shard_pieces: int) -> DataFrame:
    """Deal items (PIECES columns) into shards, evolve them on islands, return them with shard and bin."""
    shards = max(1, -(-items.count() // shard_pieces))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("row_id", F.lit(level)), F.lit(shards)))
    state = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)]))).withColumn("own", F.lit(-1).cast("long")).withColumn("migrant", F.lit(-1).cast("long"))
    schema = state.schema

    def epoch_of(epoch: int):
        def island(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("row_id", ignore_index=True)
            sizes = group["length"].tolist()
            rng = random.Random(1000 * epoch + 10 * int(group["island"][0]) + level)
            if epoch:
                population = [_of(group["own"].to_numpy(), sizes), _of(group["migrant"].to_numpy(), sizes), seeded(sizes, capacity, rng, 0.3)]
            else:
                population = [seeded(sizes, capacity, rng, 0.0 if k == 0 else 0.1 * k) for k in range(POPULATION)]
            return group.assign(own=_numbered(evolve(sizes, population, capacity, generations, rng), len(sizes)))

        return island

    for epoch in range(epochs):
        if epoch:
            # elites migrate along the ring: island i + 1 gets island i's
            moved = state.select("row_id", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.col("own").alias("migrant"))
            state = state.drop("migrant").join(moved, ["row_id", "island"]).select(*schema.names)
        state = materialised(state.groupBy("shard", "island").applyInPandas(epoch_of(epoch), schema), f"islands{level}-{epoch}")
    bins = state.groupBy("shard", "island", "own").agg(F.sum("length").cast("double").alias("fill"))
    scores = bins.groupBy("shard", "island").agg(F.count("*").alias("n_bins"), F.sum(F.col("fill") * F.col("fill")).alias("squares"))
    best = scores.groupBy("shard").agg(F.min(F.struct("n_bins", (-F.col("squares")).alias("s"), "island")).alias("b")).select("shard", F.col("b.island").alias("island"))
    return state.join(best, ["shard", "island"]).select(*items.columns, "shard", F.col("own").alias("bin"))


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack documents (doc_id, text; other columns are ignored) into sequences.

    Null text counts as empty (one end id); a null doc_id is carried; repeated rows are packed each; a long text is cut into
    pieces of `capacity` ids; pieces of one size are told apart by their row's number, so any of them may stand in a sequence;
    an empty table gives no rows; columns named as the result's don't matter. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    items = materialised(pieces(docs, tokenizer_path, capacity), "pieces")
    first = materialised(evolve_islands(items, 0, capacity, islands, epochs, generations, shard_pieces), "packed")
    fills = first.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
    judged = first.join(fills, ["shard", "bin"])
    ready = judged.where(F.col("fill") >= REOPEN_BELOW * capacity).select(*first.columns, F.lit(0).alias("level"))
    again = materialised(judged.where(F.col("fill") < REOPEN_BELOW * capacity).select(*items.columns), "reopened")
    second = evolve_islands(again, 1, capacity, islands, epochs, generations, shard_pieces).withColumn("level", F.lit(1))
    placed = ready.unionByName(second)
    sequence = F.shiftleft(F.col("shard"), 25) + F.shiftleft(F.col("bin"), 1) + F.col("level")
    placed = placed.withColumn("sequence_id", sequence.cast("long"))
    # a sequence holds at most `capacity` pieces, so this window is bounded
    before = Window.partitionBy("sequence_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
