"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs, word triples and pairs with one word left out, hashed into SLOTS.
FTRL-proximal gives each slot its own learning rate and, by L1, a weight of exactly zero unless the slot has earned one, so
the model is a short list of slots that every task gets.

Defined results: null texts are empty; empty texts score the model's bias; without training rows every score is 0;
null doc_ids count as training ids; repeated rows are carried; an empty table gives an empty result. Long texts are read whole; a
score of exactly THRESHOLD is predicted toxic; only doc_id, text and the labels are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import chunks, held_out, materialised, mix, utf8, word_hashes

BITS = 20
SLOTS = 1 << BITS
#: Bound of the training sample: about so many labelled texts, dealt by a hash of the id.
TRAIN_ROWS = 6000
EPOCHS = 5
#: Per-coordinate rate alpha / (beta + root of summed squared gradients), and the regularisers.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 12.0, 1.0
THRESHOLD = 0.3

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and slots of all features, repeated ones included."""
    data, offsets = utf8(texts)
    words, first = word_hashes(data, offsets, letters_only=True)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    rows, slots = [row], [words >> np.uint64(64 - BITS)]
    # (distances from the first word, salt)
    for steps, salt in (((1,), 3), ((1, 2), 5), ((2,), 7)):
        n = len(words) - steps[-1]
        if n <= 0:
            continue
        code = words[:n] * np.uint64(salt)
        for s in steps:
            code = mix(code) + words[s : s + n]
        whole = row[:n] == row[steps[-1] :]
        rows.append(row[:n][whole])
        slots.append((mix(code) >> np.uint64(64 - BITS))[whole])
    return np.concatenate(rows), np.concatenate(slots).astype(np.int64)


def ftrl(examples: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(slots, weights, bias) that the examples, each an array of distinct slots, leave nonzero."""
    z, n = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == SLOTS, 0.0, L1)
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            at = np.append(examples[k], SLOTS)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(SLOTS + 1))
    kept = np.flatnonzero(w[:SLOTS])
    return kept, w[kept], float(w[SLOTS])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Learn from labelled texts of the training fold; a doc_id that is labelled twice counts as toxic if one label says so."""
    fold = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    total = fold.count()
    if not total:
        return None
    share = min(1.0, rows / total)
    drawn = fold.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    # about `rows` ids at most: a bounded side
    sample = materialised(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(drawn), "doc_id"), "toxicity")

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"], ignore_index=True)
        examples = []
        for i in range(0, len(group), 64):
            row, slot = features(pa.array(group["text"][i : i + 64], pa.string()))
            examples += [np.unique(slot[row == r]) for r in range(min(64, len(group) - i))]
        slots, weights, bias = ftrl(examples, group["label"].to_numpy())
        return pd.DataFrame({"slot": np.append(slots, SLOTS), "weight": np.append(weights, bias)})

    learned = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(learn, "slot long, weight double").toPandas()
    if learned.empty:
        return None
    sparse = learned[learned["slot"] < SLOTS].sort_values("slot")
    return sparse["slot"].to_numpy(), sparse["weight"].to_numpy(), float(learned["weight"][learned["slot"] == SLOTS].iloc[0])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(SLOTS, np.float32)
        slots, weights, bias = model or (np.zeros(0, np.int64), np.zeros(0), -np.inf)
        dense[slots] = weights
        for batch in (part for whole in batches for part in chunks(whole, "text")):
            row, slot = features(batch.column(2))
            live = np.flatnonzero(dense[slot])
            pairs = np.unique(row[live] * SLOTS + slot[live])
            margin = bias + np.bincount(pairs >> BITS, dense[pairs & (SLOTS - 1)], batch.num_rows)
            value = 1 / (1 + np.exp(-np.clip(margin, -700, 700))) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value, pa.float64()), pa.array((value >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(scored, SCHEMA)
