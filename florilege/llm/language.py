"""Language identification by nearest centroids of TF-IDF character n-grams.

Texts are lower-cased, signs and digits become spaces, and byte 2-, 3- and 4-grams are hashed into DIMENSIONS slots. Vectors are
square-root TF times IDF, normalised. Each language has several centroids, found by spherical k-means over a bounded
sample of its labelled texts; a text gets the language of the centroid of largest cosine. Short texts are further from their
centroids than long ones, so what is usual is found by length: the median cosine of training texts cut to each of SIZES bytes.
A text whose cosine is below REJECT_SHARE of what is usual for its length and language is rejected by distance.

Defined results: null texts and texts without a letter give `und` with score 0, as does every text where nothing could be
learned; null doc_ids count as training ids; repeated rows are carried; long texts are read whole; of centroids at the same
cosine the first by language counts; an empty table gives an empty result; columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import chunks, held_out, materialised, utf8

DIMENSIONS = 4096
CENTROIDS = 4
#: Bound of the training sample: about so many labelled texts per language, dealt by a hash of the id.
TRAIN_PER_LANGUAGE = 300
#: Training texts of this many bytes say more than shorter ones, which are used for languages that have no others.
TRAIN_BYTES = 40
#: Bytes that training texts are cut to, and the share of the median cosine of such cuts that a text must have; texts of other
#: lengths are judged between the nearest sizes, longer ones as the longest.
SIZES, REJECT_SHARE = (4, 8, 16, 32, 64, 128, 256), 0.5
ROWS = 256

_UND = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


def counts(texts: pa.Array) -> np.ndarray:
    """Rows of n-gram counts."""
    data, offsets = utf8(pc.utf8_lower(texts.fill_null("")))
    n = len(texts)
    out = np.zeros(n * DIMENSIONS, np.float32)
    if len(data):
        data = data.copy()
        data[((data < 97) | (data > 122)) & (data < 128)] = 32
        row = np.repeat(np.arange(n), np.diff(offsets))
        gram = data.astype(np.uint32)
        code = gram
        for order in (2, 3, 4):
            if len(data) < order:
                break
            code = code[:-1] * np.uint32(257) + gram[order - 1 :]
            whole = row[: len(code)] == row[order - 1 :]
            blank = (gram[: len(code)] == 32) & (gram[1 : len(code) + 1] == 32)
            slot = ((code + np.uint32(order)) * np.uint32(2654435761)) >> np.uint32(20)
            keep = whole & ~blank
            out += np.bincount((row[: len(code)] * DIMENSIONS + slot)[keep], minlength=len(out)).astype(np.float32)
    return out.reshape(n, DIMENSIONS)


def vectors(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(raw) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def clustered(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from rows spread along the sample; fewer rows than k give as many centroids as rows."""
    centre = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ centre.T).argmax(1)
        for c in range(len(centre)):
            if (own == c).any():
                centre[c] = x[own == c].mean(0)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def cut(text: str, size: int) -> str:
    """The middle of a text, about so many bytes of it."""
    data = text.encode()
    start = max(0, (len(data) - size) // 2)
    return data[start : start + size].decode("utf-8", "ignore")


def usual(texts: list[str], centre: np.ndarray, idf: np.ndarray) -> list[float]:
    """The median cosine of texts cut to each of SIZES; where none is long enough, that of the size before, and at first 0."""
    out: list[float] = []
    for size in SIZES:
        parts = [cut(x, size) for x in texts if len(x.encode()) >= size]
        found = [np.zeros(0)]
        for k in range(0, len(parts), ROWS):
            x = vectors(counts(pa.array(parts[k : k + ROWS], pa.string())), idf)
            found.append((x @ centre.T).max(1)[x.any(1)])
        cosine = np.concatenate(found)
        out.append(float(np.median(cosine)) if len(cosine) else out[-1] if out else 0.0)
    return out


class Model:
    """Languages, their centroids (rows), idf and, for each centroid, the least cosine at each of SIZES bytes (rows)."""

    def __init__(self, languages: list[str], centroids: np.ndarray, idf: np.ndarray, least: np.ndarray):
        self.languages, self.centroids, self.idf, self.least = languages, centroids, idf, least

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        n = len(texts)
        if not self.languages:
            return [_UND] * n, np.zeros(n), np.ones(n, bool)
        cosine = vectors(counts(texts), self.idf) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(n), best].astype(np.float64), 0.0, 1.0)
        letters = np.asarray(pc.match_substring_regex(texts, r"\p{L}").fill_null(False))
        size = np.log2(np.maximum(np.diff(utf8(texts)[1]), 1))
        least = np.zeros(n)
        for b in np.unique(best):
            least[best == b] = np.interp(size[best == b], np.log2(SIZES), self.least[b])
        lang = [self.languages[b] if ok else _UND for b, ok in zip(best, letters, strict=True)]
        return lang, np.where(letters, score, 0.0), ~letters | (score < least)


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, k: int = CENTROIDS) -> Model:
    """Learn from text and lang of the training fold, a sample of about per_language rows of each language."""
    text = F.col("text").cast("string")
    fold = docs.where(~held_out() & F.col("lang").isNotNull() & text.rlike(r"\p{L}")).select("doc_id", F.col("lang").cast("string").alias("lang"), text.alias("text"))
    long = F.octet_length("text") >= TRAIN_BYTES
    counted = fold.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(long).alias("long")).collect()
    sizes = {r["lang"]: r["long"] or r["n"] for r in counted}
    short = [r["lang"] for r in counted if not r["long"]]
    fold = fold.where(long | F.col("lang").isin(short))
    if not sizes:
        return Model([], np.zeros((0, DIMENSIONS)), np.ones(DIMENSIONS), np.zeros((0, len(SIZES))))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(9)), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)
    sample = materialised(fold.where(draw), "languages")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMENSIONS, np.int64)
        for batch in (part for whole in batches for part in chunks(whole, "text", rows=ROWS)):
            n += batch.num_rows
            df += (counts(batch.column(0)) > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([df.tolist()])], names=["n", "df"])

    parts = sample.select("text").mapInArrow(frequencies, "n long, df array<long>").collect()
    n = sum(p["n"] for p in parts)
    df = sum((np.array(p["df"]) for p in parts), np.zeros(DIMENSIONS))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def centres(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id", ignore_index=True)
        x = np.concatenate([vectors(counts(pa.array(group["text"][i : i + ROWS], pa.string())), idf) for i in range(0, len(group), ROWS)])
        centre = clustered(x, k)
        least = [REJECT_SHARE * x for x in usual(group["text"].tolist(), centre, idf)]
        return pd.DataFrame({"lang": group["lang"][0], "least": [least] * len(centre), "centre": [c.tolist() for c in centre]})

    found = sample.groupBy("lang").applyInPandas(centres, "lang string, least array<double>, centre array<float>").orderBy("lang", "centre").collect()
    return Model([r["lang"] for r in found], np.array([r["centre"] for r in found], np.float32), idf, np.array([r["least"] for r in found]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, rejected (by distance, or `und`)."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in chunks(whole, "text", rows=ROWS)):
            lang, score, rejected = model(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(label, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that aren't rejected; ids may repeat, so rows are judged where they stand."""
    model = train(docs)
    names, types = docs.columns, docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in (part for whole in batches for part in chunks(whole, "text", rows=ROWS)):
            yield batch.filter(pa.array(~model(batch.column(at))[2]))

    return docs.mapInArrow(keep, types)
