"""Source divergence audit: how far the sources of a language are from one another, and the terms that mark each.

Terms are counted by (lang, source), and dealt by range, so that each task gets a stretch of the sorted terms of a language. It
takes the terms that enough documents hold, sorted, numbers occurrences by their place among them, and counts the numbers of
each source into a dense row. Numbers keep the order of terms by UTF-8, so ties go by number. Stretches are scored with the
totals of the whole language; scores of pairs are summed in each task before they are shuffled.

Defined results: null text, lang and source are empty ones; each row is a document, so repeated rows count each; doc_id isn't
read, so it may be null; groups without kept terms have pairs of value 0 and no terms; a language with one source has no pairs;
long texts are read whole; ties are broken by the item; an empty table gives an empty one; other columns may have any name.
Counts are exact up to 2^53 occurrences of a term and 9 * 10^15 of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.llm.common import chunks, materialised, utf8

#: Documents of a language that hold a kept term at least, terms listed of each group, and the whole that shares are of.
LEAST_DOCUMENTS, LISTED, WHOLE = 10, 10, 1_000_000_000
#: Bytes of text counted at once, cells of a dense stretch at most, groups whose totals are sent to every task at most, and pairs
#: of sources whose sums a task holds at most; sums of more pairs are given out stretch by stretch.
STEP_BYTES, CELLS, BROADCAST_GROUPS, PAIRS = 4 << 20, 1 << 19, 20_000, 1 << 22

#: Bytes of terms (letters, and all of characters that aren't ASCII), and A-Z lowered.
_IN_TERM = np.zeros(256, bool)
_IN_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[0x41:0x5B] += 0x20

COUNTS = "lang string, source string, term string, n long, documents long"


def _coded(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different values of a column, and the number of each row's."""
    coded = column.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices, np.int64)


def _occurrences(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different terms of texts in a row, and of each occurrence the number of its term and of its text."""
    inside = _IN_TERM[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[first] = inside[first]
    starts = np.flatnonzero(begin)
    held = np.cumsum(inside, dtype=np.int64)
    ends = np.append(held[starts] - 1, held[-1] if len(held) else 0).astype(np.int32)
    terms, codes = _coded(pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(_LOWERED[data[inside]])]))
    return terms, codes, np.searchsorted(offsets, starts, "right") - 1


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents): occurrences, and documents that hold the term; a row without a term stands for each
    group, whatever its texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "text", STEP_BYTES)):
            (langs, lang), (sources, source) = _coded(batch.column(0)), _coded(batch.column(1))
            groups, group = np.unique(lang * len(sources) + source, return_inverse=True)
            terms, code, text = _occurrences(*utf8(batch.column(2)))
            width = max(1, len(terms))
            held, n = np.unique(text * width + code, return_counts=True)  # a text's different terms
            cells, cell = np.unique(group[held // width] * width + held % width, return_inverse=True)
            at = np.concatenate([groups[cells // width], groups]).astype(np.int64)
            total = np.concatenate([np.bincount(cell, n, len(cells)), np.zeros(len(groups))]).astype(np.int64)
            own = np.concatenate([np.bincount(cell, minlength=len(cells)), np.zeros(len(groups), np.int64)])
            names = pa.concat_arrays([terms.take(pa.array(cells % width)), pa.array([""] * len(groups), pa.string())])
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(at // len(sources))), sources.take(pa.array(at % len(sources))), names, pa.array(total), pa.array(own)], names=["lang", "source", "term", "n", "documents"])

    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*filled).mapInArrow(run, COUNTS)
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


DENSE = "lang string, terms array<string>, sources array<string>, counts array<long>, sums array<long>"


def _stretches(rows: pa.Table, least: int) -> Iterator[dict]:
    """Dense rows of COUNTS sorted by lang and term, of which no term is cut off."""
    langs, lang = _coded(rows["lang"].combine_chunks())
    for k, name in enumerate(langs.to_pylist()):
        own = rows.filter(pa.array(lang == k))
        terms, term = _coded(own["term"].combine_chunks())
        enough = np.bincount(term, np.asarray(own["documents"]), len(terms)) >= least
        kept = np.flatnonzero(enough & np.asarray(pc.not_equal(terms, "")))  # sorted, as the rows are
        sources, source = _coded(own["source"].combine_chunks())
        n = np.asarray(own["n"])
        step = max(1, CELLS // max(1, len(sources)))
        for start in range(0, len(kept), step):
            ids = kept[start : start + step]
            place = np.searchsorted(ids, term)
            hit = (place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == term)
            cells = np.bincount(source[hit] * len(ids) + place[hit], n[hit], len(sources) * len(ids)).astype(np.int64)
            yield {"lang": name, "terms": terms.take(pa.array(ids)).to_pylist(), "sources": sources.to_pylist(), "counts": cells, "sums": cells.reshape(len(sources), -1).sum(1)}


def dense(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """DENSE rows: for a stretch of a language's kept terms, how often each of its sources has each."""
    schema = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if not rows.num_rows:
                continue
            # the last term may go on in the next batch
            last = (rows["lang"][-1], rows["term"][-1])
            same = np.asarray(pc.and_(pc.equal(rows["lang"], last[0]), pc.equal(rows["term"], last[1])))
            cut = int(np.argmax(same))
            rest = rows.slice(cut)
            for row in _stretches(rows.slice(0, cut), least):
                yield pa.RecordBatch.from_pylist([row], schema=schema)
        if rest is not None:
            for row in _stretches(rest, least):
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    dealt = counts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.select("lang", "source", "term", "n", "documents").mapInArrow(run, DENSE)


def totals(counts: DataFrame, stretches: DataFrame) -> DataFrame:
    """A row per language: lang, v (kept terms), groups (array of source and n, sorted). Its size follows the number of sources."""
    groups = counts.where("term = ''").select("lang", "source")
    sums = stretches.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("n"))
    each = groups.join(sums, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("n", F.lit(0).cast("long")).alias("n")).alias("g"))
    kept = stretches.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    gathered = each.groupBy("lang").agg(F.array_sort(F.collect_list("g")).alias("groups"))
    return gathered.join(kept, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).cast("long").alias("v"), "groups")


def shares(counts: np.ndarray, total: int | np.ndarray) -> np.ndarray:
    """1 + floor(WHOLE * (count + 2) / total), three digits at a time, as the product may not fit 64 bits."""
    left, out = counts + 2, np.zeros_like(counts)
    # no count exceeds its total, so neither does left; a total is below 9 * 10^15
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


PARTS = "lang string, part string, source string, item string, value long"


def scores(stretches: DataFrame, totals: DataFrame, listed: int = LISTED) -> DataFrame:
    """PARTS rows: of each two sources (the first in order as source) sums over some terms, and the best terms of stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, tuple[list[str], np.ndarray]] = {}

        def given(lang: str, names: list[str], i: int, sums: np.ndarray) -> pa.RecordBatch:
            """Pairs of source i with those behind it."""
            rows = [{"lang": lang, "part": "pair", "source": names[i], "item": names[j], "value": int(v)} for j, v in enumerate(sums, i + 1)]
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, (names, sums) in pairs.items():
                for i in range(len(names) - 1):
                    yield given(lang, names, i, sums[i, i + 1 :])
            pairs.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                lang, v, groups = row["lang"].as_py(), row["v"].as_py(), row["groups"].as_py()
                names, terms = [g["source"] for g in groups], row["terms"].values
                n = np.array([g["n"] for g in groups], np.int64)[:, None]
                where = {s: i for i, s in enumerate(names)}
                counts = np.zeros((len(names), len(terms)), np.int64)
                if len(terms):
                    counts[[where[s] for s in row["sources"].as_py()]] = np.asarray(row["counts"].values).reshape(-1, len(terms))
                held = len(names) ** 2 <= PAIRS
                if held and lang not in pairs:
                    if sum(x.size for _, x in pairs.values()) + len(names) ** 2 > PAIRS:
                        yield from flushed()
                    pairs[lang] = names, np.zeros((len(names), len(names)), np.int64)
                if not held and not len(terms):
                    for i in range(len(names) - 1):
                        yield given(lang, names, i, np.zeros(len(names) - 1 - i, np.int64))
                step = max(1, CELLS // len(names))
                best: list[dict] = []
                for start in range(0, len(terms), step):
                    own = counts[:, start : start + step]
                    p = shares(own, n + 2 * v)
                    whole = shares(own.sum(0), int(n.sum()) + 2 * v)
                    for i in range(len(names)):
                        sums = distance(p[i], p[i + 1 :]).sum(1)
                        if held:
                            pairs[lang][1][i, i + 1 :] += sums
                        elif len(sums):
                            yield given(lang, names, i, sums)
                        marks = np.flatnonzero((own[i] > 0) & (p[i] > whole))
                        value = distance(p[i][marks], whole[marks])
                        top = np.lexsort((marks, -value))[:listed]
                        best += [{"lang": lang, "part": "term", "source": names[i], "item": terms[start + int(marks[t])].as_py(), "value": int(value[t])} for t in top]
                if best:
                    yield pa.RecordBatch.from_pylist(best, schema=schema)
        yield from flushed()

    schema = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    empty = F.array().cast("array<string>")
    nothing = totals.select("lang", empty.alias("terms"), empty.alias("sources"), F.array().cast("array<long>").alias("counts"))  # so that all pairs come
    few = totals.agg(F.sum(F.size("groups"))).first()[0] or 0
    rows = stretches.select("lang", "terms", "sources", "counts").unionByName(nothing)
    # a language may hold most rows; where totals are too large to be sent, the join splits such a key at run time
    return rows.join(F.broadcast(totals) if few <= BROADCAST_GROUPS else totals, "lang").mapInArrow(run, PARTS)


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, listed: int = LISTED) -> DataFrame:
    """lang, source, part, item, value, rank: every other source of the language by distance, and the terms that mark a source."""
    counts = materialised(counted(docs), "term-counts")
    stretches = materialised(dense(counts, least), "stretches")
    found = materialised(scores(stretches, materialised(totals(counts, stretches), "totals"), listed), "divergence")
    sums = found.where("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = sums.select("lang", "part", F.explode(ways).alias("x"), "value").select("lang", "x.source", "part", "x.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = found.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", rank).where(F.col("rank") <= listed)
    return pairs.withColumn("rank", rank).unionByName(terms)


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE_SQL = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS MATERIALIZED (SELECT lang, source, k, term, count(*) AS n FROM (SELECT lang, source, k, unnest(regexp_extract_all(translate(text, {_LETTERS}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(*) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, sum(n) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
cells AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
own AS MATERIALIZED (SELECT lang, source, term, n, 1 + ({WHOLE}::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM cells JOIN v USING (lang)),
whole AS (SELECT lang, term, 1 + ({WHOLE}::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM own AS x JOIN own AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) AS s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR rank <= {LISTED}"""
