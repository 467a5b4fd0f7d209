"""Stored indexes, dictionary masks and canonical digests against brute force."""

import json
import random

import pytest
from pyspark.sql import functions as F

from florilege.functions import hashing
from florilege.operators import indexes, similarity


def test_substring_search_against_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["ab", "c", "é", "%", "_", " ", "Zz", "\n", "😀"]) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "ab"]
    keys = [k if k % 3 else k + (k << 17) for k in range(len(texts))]
    items = spark.createDataFrame([(k, t, "x") for k, t in zip(keys, texts, strict=True)], "block long, text string, id string")
    indexes.index_texts(items, "block", "text", str(tmp_path / "i"))
    requests = ["abc", "AB%", "c_é zz", "%_% ab", "a", "", "ababababab", "é😀 c", "zzz_", "ab zz c % _ é ab zz c % _ é nothing-behind-the-twelfth"]
    requests += ["".join(t[a : a + 5].split()[:1]) for t in rng.sample(texts[:300], 15) if (a := rng.randrange(max(1, len(t) - 5))) >= 0]
    for looked_up in (1000, 3):
        monkeypatch.setattr(indexes, "LOOKED_UP", looked_up)
        for request in requests:
            words = [w.lower() for w in request.split()[:12]]
            expected = sorted(k for k, t in zip(keys, texts, strict=True) if all(w in (t or "").lower() for w in words))
            assert sorted(r["id"] for r in indexes.search(spark, str(tmp_path / "i"), request).collect()) == expected, request
        requests = requests[:4]


def test_search_opens_postings_and_few_texts(spark, tmp_path):
    items = spark.createDataFrame([(k << 12, f"text number {k} of many") for k in range(200)], "id long, text string")
    indexes.index_texts(items, "id", "text", str(tmp_path / "i"))
    found = indexes.search(spark, str(tmp_path / "i"), "number 117")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(block" in plan or "PartitionFilters: [block" in plan, plan
    assert "In(id" in plan or "EqualTo(id" in plan or "PushedFilters: [IsNotNull(id), EqualTo(id" in plan, plan
    assert [r["id"] for r in found.collect()] == [117 << 12]
    postings = indexes.candidates(spark, str(tmp_path / "i"), ["number", "117"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in postings


def test_facets_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice([rng.randrange(0, 50), rng.randrange(0, 200_000)]), t, f"{t}{rng.randrange(4)}") for _ in range(1500) for t in [rng.choice("abc")]]
    index = indexes.term_bitmaps(spark.createDataFrame([*rows, (None, "a", "a1")], "item long, taxonomy string, term string"), "item")
    for filters in ({}, {"a": ("a1",)}, {"a": ("a1", "a2"), "b": ("b0",)}, {"a": ("a0", "a1", "a2"), "b": ("b0", "b1", "b2"), "c": ("c1", "c2")}, {"a": ("none",)}):
        chosen = {i for i, _, _ in rows if all(any((i, t, x) in set(rows) for x in terms) for t, terms in filters.items())} if len(filters) < 2 else set.intersection(*[{i for i, t, x in rows if t == name and x in terms} for name, terms in filters.items()])
        expected = {(t, x): len({i for i, u, y in rows if (u, y) == (t, x) and i in chosen}) for _, t, x in rows}
        got = {(r["taxonomy"], r["term"]): r["n"] for r in indexes.facets_under(index, filters).collect()}
        assert got == {k: n for k, n in expected.items() if n}


def test_masks_and_missing_words(spark):
    words = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4), ("a", 5)], "word string, n long")
    lists = {"x": ["a", "a", "d"], "y": [], "z": ["b", "a", None]}
    known = {k: spark.createDataFrame([(w,) for w in v], "word string") for k, v in lists.items()}
    got = sorted(map(tuple, similarity.membership(words, known).collect()), key=repr)
    assert got == sorted([("a", 1, 5), ("b", 2, 4), ("c", 3, 0), (None, 4, 0), ("a", 5, 5)], key=repr)
    assert sorted((r["n"] for r in similarity.missing_words(words, list(known.values())).collect())) == [3, 4]
    with pytest.raises(ValueError):
        similarity.membership(words, {str(k): known["x"] for k in range(64)})


def test_canonical_digests(spark):
    rng = random.Random(1)

    def value(depth=0):
        kind = rng.randrange(6 if depth < 4 else 3)
        if kind == 0:
            return rng.choice(["", "é", 'q"', "\n", "😀"])
        if kind < 3:
            return rng.choice([None, True, 0, -3, 2.5, 7.0, 10**20])
        if kind == 3:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice("abcdeé"): value(depth + 1) for _ in range(rng.randrange(5))} | ({"lowerBound": value(depth + 1)} if rng.random() < 0.4 else {})

    def shuffled(x):
        if isinstance(x, dict):
            items = [(k, rng.random() if k in hashing.BOUNDS else shuffled(v)) for k, v in x.items()]
            rng.shuffle(items)
            return dict(items)
        return [shuffled(v) for v in x] if isinstance(x, list) else x

    def bare(x):
        if isinstance(x, dict):
            return tuple(sorted((k, None if k in hashing.BOUNDS else bare(v)) for k, v in x.items()))
        return ["list", *map(bare, x)] if isinstance(x, list) else (type(x) is bool, float(x) if type(x) in (int, float) and abs(x) < 2**53 else x)

    values = [value() for _ in range(300)]
    rows = [(k, json.dumps(v), json.dumps(shuffled(v), indent=1, ensure_ascii=False)) for k, v in enumerate(values)] + [(-1, None, "no json"), (-2, "{", "")]
    df = spark.createDataFrame(rows, "k long, a string, b string").select("k", *[hashing.canonical_digest(F.col(c)).alias(c) for c in "ab"])
    got = {r["k"]: (r["a"], r["b"]) for r in df.collect()}
    assert got[-1] == got[-2] == (None, None)
    assert all(got[k][0] == got[k][1] for k in range(300))
    different = {repr(bare(v)) for v in values}
    assert len({a for k, (a, _) in got.items() if k >= 0}) == len(different)
