"""Many patterns at once, against regular expressions and plain search."""

import random
import re

import pytest

from florilege.operators import patterns


def plain_words(text, wrong):
    """Whole words, the longest first, as an alternation finds them."""
    if not wrong:
        return []
    rule = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(wrong, key=lambda x: (-len(x), x)))) + r")\b")
    return [(m.start(), m[0]) for m in rule.finditer(text)]


def test_finder_against_regular_expressions():
    rng = random.Random(5)
    for _ in range(400):
        wrong = sorted({"".join(rng.choice(["a", "b", "é", " ", "ab", "_", "."]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(8))} - {""})
        finder = patterns.Finder(wrong)
        text = "".join(rng.choice(["a", "b", "é", " ", "ab", "_", ".", "-"]) for _ in range(rng.randrange(60)))
        assert [(p, wrong[k]) for p, k in finder.words(text)] == plain_words(text, wrong), (text, wrong)
        assert [wrong[k] for k in finder.held(text)] == [w for w in wrong if w in text]


def test_a_thousand_patterns_over_texts(spark, monkeypatch):
    rng = random.Random(6)
    letters = "abcdeé"
    wrong = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) + rng.choice(["", " ab", " é"]) for _ in range(1500)})[:1000]
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(80)).title() for _ in range(60)] + [None, "", "İab ab", "ab " * 20_000]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "id long, text string, n string")
    table = spark.createDataFrame([(w.upper(), f"right of {w}") for w in wrong] + [("", "x"), (None, "y"), (wrong[0], "aa is first by name")], "wrong string, right string")
    got = patterns.whole_words(docs, "text", table)
    assert got.columns == ["id", "text", "n", "place", "found", "wrong", "right"]
    rows = {(r["id"], r["place"], r["wrong"]): (r["found"], r["right"]) for r in got.collect()}
    low = [patterns.lowered(t or "") for t in texts]
    assert set(rows) == {(k, p, w) for k, t in enumerate(low) for p, w in plain_words(t, wrong)}
    assert all(found == texts[k][p : p + len(w)] and right in (f"right of {w}", "aa is first by name") for (k, p, w), (found, right) in rows.items())
    expected = sorted((k, w) for k, t in enumerate(low) for w in wrong if w in t)
    assert sorted((r["id"], r["wrong"]) for r in patterns.holding(docs, "text", table).collect()) == expected
    monkeypatch.setattr(patterns, "LIST", 300)  # in several passes
    assert sorted((r["id"], r["wrong"]) for r in patterns.holding(docs, "text", table).collect()) == expected
    with pytest.raises(ValueError):
        patterns.whole_words(docs, "text", table)
    monkeypatch.undo()
    none = table.limit(0)
    assert patterns.holding(docs, "text", none).count() == patterns.whole_words(docs, "text", none).count() == patterns.holding(docs.limit(0), "text", table).count() == 0


def test_whole_words_in_passes_are_those_of_one_list(spark, monkeypatch):
    rng = random.Random(8)
    letters = "abcé"
    wrong = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) + rng.choice(["", " ab", " é", " a b"]) for _ in range(400)})
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(60)).title() for _ in range(40)] + [None, "", "ab a b ab"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate([*texts, texts[0]])], "row long, text string, n string")
    table = spark.createDataFrame([(w, f"right of {w}") for w in wrong], "wrong string, right string")
    one = patterns.whole_words(docs, "text", table)
    monkeypatch.setattr(patterns, "LIST", 60)  # in several passes, with patterns that overlap in different ones
    many = patterns.whole_words_in_passes(docs, "text", table)
    assert many.columns == one.columns and one.count() > 1000
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))


def test_a_list_is_filled_before_there_are_two(spark, monkeypatch):
    """The benchmark's words and pairs are more than half a list."""
    monkeypatch.setattr(patterns, "LIST", 10)
    docs = spark.createDataFrame([(1, "w1 w9")], "id long, text string")
    table = spark.createDataFrame([(f"w{k}", None) for k in range(10)], "wrong string, right string")
    assert sorted(r["wrong"] for r in patterns.whole_words(docs, "text", table).collect()) == ["w1", "w9"]


def test_finds_in_long_texts_are_handed_on_piece_by_piece(spark, monkeypatch):
    """Each find carries its text, so the finds of a batch may have more bytes than a batch can hold."""
    monkeypatch.setattr(patterns, "OUT_BYTES", 10_000)
    docs = spark.createDataFrame([(k, "ab " * 2000) for k in range(3)], "id long, text string").coalesce(1)
    table = spark.createDataFrame([("ab", None)], "wrong string, right string")
    got = patterns.whole_words(docs, "text", table)
    assert got.agg({"place": "sum"}).first()[0] == 3 * sum(range(0, 6000, 3))
    sizes = patterns.whole_words_in_passes(docs, "text", table, keep=["id"])
    assert sizes.columns == ["id", "place", "found", "wrong", "right"] and sizes.count() == 6000
