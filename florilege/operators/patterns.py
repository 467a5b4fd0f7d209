"""Many fixed patterns sought in texts at once, by an Aho-Corasick automaton that each task builds of a short list.

A text is gone through once, however many patterns there are. Lists longer than LIST are sought in several passes of so many
patterns each, so what a task holds is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.operators.dedup import fresh
from florilege.operators.stored import stored

#: Patterns of one pass, and characters that they may have together.
LIST, LIST_CHARS = 20_000, 2_000_000
#: Bytes of finds that are handed on at once.
OUT_BYTES = 8 << 20


def lowered(text: str) -> str:
    """text in lower case, letter by letter, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


class Finder:
    """Finds patterns, which are lower-case, in lower-case texts."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for k, pattern in enumerate(patterns):
            if pattern:
                self.automaton.add_word(pattern, (k, len(pattern)))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def held(self, text: str) -> list[int]:
        """The numbers of the patterns that stand anywhere in a text, each once."""
        return sorted({k for _, (k, _) in self.automaton.iter(text)}) if self.any else []

    def words(self, text: str) -> list[tuple[int, int]]:
        """(place, number) of patterns that stand as whole words, from the left, the longest first, none within another."""
        found, upto = [], 0
        for start, size, k in self.longest(text):
            if start >= upto:
                found.append((start, k))
                upto = start + size
        return found

    def longest(self, text: str) -> list[tuple[int, int, int]]:
        """(place, length, number) of the longest pattern that stands as whole words at each place, whether within another or not."""
        whole: dict[int, tuple[int, int]] = {}
        for end, (k, size) in self.automaton.iter(text) if self.any else ():
            start = end - size + 1
            if self._bounded(text, start) and self._bounded(text, end + 1) and whole.get(start, (0, 0))[0] < size:
                whole[start] = (size, k)
        return [(start, *whole[start]) for start in sorted(whole)]

    @staticmethod
    def _bounded(text: str, place: int) -> bool:
        """Whether a word begins or ends at a place."""
        before = place > 0 and _in_word(text[place - 1])
        after = place < len(text) and _in_word(text[place])
        return before != after


def _lists(patterns: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """patterns (wrong, right), lower-cased, each once, in lists of bounded size. Of several right ones the first by name counts."""
    kept = patterns.where(F.coalesce("wrong", F.lit("")) != "").groupBy(F.lower("wrong").alias("wrong")).agg(F.min("right").alias("right"))
    kept = stored(kept, "patterns")
    said = kept.agg(F.count("*").alias("n"), F.sum(F.length("wrong")).alias("chars")).first()
    lists = max(1, -(-said["n"] // (LIST // 2)), -(-(said["chars"] or 0) // (LIST_CHARS // 2)))
    if said["n"] <= LIST and (said["chars"] or 0) <= LIST_CHARS:
        lists = 1  # nothing is dealt out, so no list is longer than others
    for k in range(lists):
        yield [tuple(r) for r in kept.where(F.pmod(F.xxhash64("wrong"), F.lit(lists)) == k).collect()]


def _sought(texts: DataFrame, column: str, patterns: list[tuple[str, str | None]], words: bool, apart: bool = True, keep: list[str] | None = None) -> DataFrame:
    """apart: whether whole words that stand within others are left out. keep: the columns of texts that are handed on, if not all."""
    keep = texts.columns if keep is None else keep
    names = texts.columns
    added = "place long, found string, wrong string, right string" if words else "wrong string, right string"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields if f.name in keep), added])
    kinds = [pa.int64(), *[pa.string()] * 3] if words else [pa.string()] * 2
    new_names = [*(["place", "found"] if words else []), "wrong", "right"]
    kept = [k for k, name in enumerate(names) if name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder([wrong for wrong, _ in patterns])

        def found(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
            for row, text in enumerate(batch.column(names.index(column)).to_pylist()):
                low = lowered(text or "")
                if words:
                    for place, k in finder.words(low) if apart else [(place, k) for place, _, k in finder.longest(low)]:
                        yield row, (place, text[place : place + len(patterns[k][0])], *patterns[k])
                else:
                    yield from ((row, patterns[k]) for k in finder.held(low))

        def out(batch: pa.RecordBatch, finds: list[tuple[int, tuple]]) -> pa.RecordBatch:
            new = [pa.array(list(values), kind) for values, kind in zip(zip(*[x for _, x in finds], strict=True), kinds, strict=True)]
            old = [batch.column(k).take(pa.array([row for row, _ in finds])) for k in kept]
            return pa.RecordBatch.from_arrays([*old, *new], names=[*[names[k] for k in kept], *new_names])

        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                # a row is handed on with each of its finds, so what is handed on at once goes by bytes
                size = [sum(batch.column(k).slice(row, 1).nbytes for k in kept) for row in range(batch.num_rows)] if kept else [0] * batch.num_rows
                finds, held = [], 0
                for find in found(batch):
                    finds.append(find)
                    held += size[find[0]] + 100
                    if held > OUT_BYTES:
                        yield out(batch, finds)
                        finds, held = [], 0
                if finds:
                    yield out(batch, finds)

    return texts.mapInArrow(run, schema)


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def holding(texts: DataFrame, column: str, patterns: DataFrame) -> DataFrame:
    """texts with each of patterns (wrong, right) that their column holds anywhere, whatever the case: a row for each, with wrong
    and right added. Null and empty texts hold none; empty patterns are passed over; a text may be of any length."""
    return _united([_sought(texts, column, part, False) for part in _lists(patterns)])


def whole_words(texts: DataFrame, column: str, patterns: DataFrame) -> DataFrame:
    """texts with each occurrence of patterns (wrong, right) as whole words, whatever the case: a row for each, with place (from
    0), found (as it stands there), wrong and right added. Occurrences are taken from the left, the longest first, and don't
    overlap; so patterns must fit into one list. whole_words_in_passes() takes any number."""
    lists = list(_lists(patterns))
    if len(lists) > 1:
        raise ValueError(f"patterns that may overlap must fit into a list of {LIST}")
    return _sought(texts, column, lists[0], True)


def whole_words_in_passes(texts: DataFrame, column: str, patterns: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The same rows as whole_words() for any number of patterns, with all columns of texts or those of `keep`. Where they need several lists, each pass gives the longest that
    it finds at every place, and a text's finds are brought together to see which of them stand."""
    lists = list(_lists(patterns))
    if len(lists) == 1:
        return _sought(texts, column, lists[0], True, keep=keep)
    row = fresh("row", [*texts.columns, "place", "found", "wrong", "right"])
    texts_ = stored(texts.withColumn(row, F.monotonically_increasing_id()), "texts")
    found = _united([_sought(texts_.select(row, column), column, part, True, False, [row]) for part in lists])

    def standing(frame: pd.DataFrame) -> pd.DataFrame:
        kept, upto = [], 0
        frame = frame.assign(size=frame["found"].str.len()).sort_values(["place", "size"], ascending=[True, False])
        for i, (place, size) in enumerate(zip(frame["place"], frame["size"], strict=True)):
            if place >= upto:
                kept.append(i)
                upto = place + size
        return frame.drop(columns="size").iloc[kept]

    kept = found.groupBy(row).applyInPandas(standing, found.schema)
    return texts_.join(kept, row).select(*[F.col(f"`{c}`") for c in texts.columns if keep is None or c in keep], "place", "found", "wrong", "right")
