"""Decontamination finds whatever its verifier accepts: the masks over all patterns, and find() against a count without masks."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from florilege.llm import decontamination


def _least(size):
    return math.ceil(size * decontamination.SHARE - 1e-9)


def _missed(masks, size):
    """Patterns of as many replaced words as the verifier allows in which no mask sees only words that agree."""
    seen = [sum(1 << (k + at) for k in m) for m in masks for at in range(size - m[-1])]
    missed = 0
    for gone in itertools.combinations(range(size), size - _least(size)):
        replaced = sum(1 << k for k in gone)
        missed += all(s & replaced for s in seen)
    return missed


def _check(spark, cases):
    """cases: (item words, places replaced); find() must report item k in document k with the count of the best window, and nothing else."""
    rng = random.Random(7)
    docs, items, expected = [], [], {}
    for k, (n, gone) in enumerate(cases):
        item = [f"w{k}x{i}" for i in range(n)]
        items.append((k, " ".join(item)))
        own = [f"o{k}x{i}" if i in gone else w for i, w in enumerate(item)]
        docs.append((k, " ".join([f"b{k}x{i}" for i in range(rng.randrange(3))] + own + [f"e{k}x{i}" for i in range(rng.randrange(3))])))
        size = min(decontamination.WINDOW, n)
        best = max(sum(i not in gone for i in range(b, b + size)) for b in range(n - size + 1))
        if best >= _least(size):
            expected[k, k] = (best, size)
    docs, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for most in (decontamination.BROADCAST_SEEDS, 0):
        got = {(r["doc_id"], r["item_id"]): (r["matched"], r["window"]) for r in decontamination.find(docs, bench, most).collect()}
        assert got == expected
    return expected


@pytest.mark.parametrize("size", range(decontamination.LONG, decontamination.WINDOW + 1))
def test_masks_see_every_accepted_pattern(size):
    assert _missed(decontamination.SEED_MASKS, size) == 0


def test_substitutions_of_long_items(spark):
    rng = random.Random(5)
    cases = [(n, {i for i in range(n) if i % period == first}) for period in range(3, 9) for first in (0, period - 1) for n in (20, 43, 60)]
    cases += [(n, set(rng.sample(range(n), gone))) for n in (13, 16, 20) for gone in range(3, 7) for _ in range(12)]
    expected = _check(spark, cases)
    assert all((k, k) in expected for k, (n, gone) in enumerate(cases) if gone == {i for i in range(n) if i % 5 == 4})


@pytest.mark.parametrize("size", range(1, decontamination.LONG))
def test_short_masks_see_every_accepted_pattern(size):
    assert _missed(decontamination.masks_of(size), size) == 0


def test_substitutions_of_short_items(spark):
    cases = [(n, set(gone)) for n in range(1, 10) for k in range(3) for gone in itertools.combinations(range(n), k)]
    assert len(_check(spark, cases)) == sum(n - len(gone) >= _least(n) for n, gone in cases)


def test_columns_named_as_the_results(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "a b c d e f"), (6, "..."), (7, "G")], "item_id long, text string")
    for name in ("item_id", "h", "place", "pair", "seed", "matched", "window", "item_h", "_found"):
        docs = docs.withColumn(name, F.lit("x"))
    for name in ("doc_id", "h", "place", "pair", "seed", "matched"):
        bench = bench.withColumn(name, F.lit("x"))
    for most in (decontamination.BROADCAST_SEEDS, 0):
        assert sorted(map(tuple, decontamination.find(docs, bench, most).collect())) == [(1, 5, 6, 6), (1, 7, 1, 1)]
    assert decontamination.clean(docs, bench).collect() == [] and decontamination.clean(docs, bench.limit(0)).collect() == docs.collect()
    assert decontamination.find(docs, bench.where("item_id = 6")).columns == ["doc_id", "item_id", "matched", "window"]
