"""The pipeline over a small corpus, each stage against brute force on what its predecessor kept, and over odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from florilege.llm import decontamination

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def prose(rng, lang, n):
    syllables = {"en": ("the", "ing", "ther", "and", "wh", "ed"), "pt": ("ção", "ões", "nho", "lha", "que", "dor")}[lang]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(17)
    texts = [(prose(rng, lang, rng.randrange(40, 90)), lang) for _ in range(60) for lang in ("en", "pt")]
    items = [prose(rng, "en", n) for n in (30, 18, 9)]
    base = texts[0][0].split()
    texts += [(" ".join(w if i % 40 else "other" for i, w in enumerate(base)), "en"), (texts[1][0], "pt"), (texts[1][0].upper(), None)]
    texts += [(f"{prose(rng, 'en', 20)} {items[0]} {prose(rng, 'en', 10)}", "en"), (" ".join("x" if i % 6 == 5 else w for i, w in enumerate(items[1].split())), "en"), (f"{prose(rng, 'en', 9)} {items[2].title()}.", "en")]
    texts += [(f"{prose(rng, 'en', 30)} mail a.b@c.org and 4111 1111 1111 1111, or +351 21 123 4567 é 10.0.0.1", "en")]
    texts += [("我们 的 语言 是 中文 大家 好", None), ("12 34 ...", "en"), ("", "en"), (None, "en")]
    folder = tmp_path_factory.mktemp("corpus")
    rows = [(k, t, lang, "s", len(t or "")) for k, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {r[0]: r[1] for r in rows}, items


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def holds(text, item):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    own, item = split(text), split(item)
    size = min(decontamination.WINDOW, len(item))
    return any(
        sum(0 <= j + shift < len(own) and own[j + shift] == item[j] for j in range(begin, begin + size)) >= decontamination.SHARE * size - 1e-9
        for shift in range(-len(item), len(own))
        for begin in range(len(item) - size + 1)
    )


def test_stages_against_brute_force(spark, corpus):
    folder, texts, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in STAGES["language_id"](spark, docs, folder).collect()}
    foreign = {k for k, t in texts.items() if not any("a" <= c <= "z" or "A" <= c <= "Z" for c in t or "")}
    assert kept == {k: t for k, t in texts.items() if k not in foreign}

    sets = {k: shingles(t) for k, t in kept.items()}
    root = {k: k for k in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    expected = {k: t for k, t in kept.items() if root[k] == k}
    after = STAGES["ngram_jaccard_join"](spark, docs.where(F.col("doc_id").isin(list(kept))), folder)
    assert {r["doc_id"]: r["text"] for r in after.collect()} == expected and len(expected) <= len(kept) - 2

    before = len(expected)
    expected = {k: t for k, t in expected.items() if not any(holds(t, item) for item in items)}
    after = STAGES["benchmark_decontamination"](spark, after, folder)
    assert {r["doc_id"]: r["text"] for r in after.collect()} == expected and len(expected) == before - 3

    after = STAGES["pii"](spark, after, folder)
    for found, mark in (("a.b@c.org", "[EMAIL]"), ("4111 1111 1111 1111", "[CARD]"), ("+351 21 123 4567", "[PHONE]"), ("10.0.0.1", "[IP]")):
        expected = {k: t.replace(found, mark) for k, t in expected.items()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == expected and sum("[CARD]" in t for t in expected.values()) == 1

    packed = STAGES["best_fit_packing"](spark, after, folder).collect()
    assert sorted(r["doc_id"] for r in packed) == sorted(expected)
    total = sum(r["length"] for r in packed)
    assert len({r["sequence_id"] for r in packed}) == -(-total // 4096)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).drop("sequence_id", "offset").collect())) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)


def test_stages_take_odd_rows(spark, corpus):
    folder, texts, _ = corpus
    rows = [(None, None, None), (None, "the and the whing", "en"), (1, "", "en"), (1, None, None), (2, texts[0], "en"), (2, texts[0], "en"), (2, texts[1], "pt"), (3, "the " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("held_out", "rejected", "sig", "_sig", "_kept", "rep", "component", "h", "place", "spans", "cut", "found", "_found", "_pii_email", "score"):
        docs = docs.withColumn(name, F.lit(1))
    counts = {"language_id": None, "ngram_jaccard_join": 7, "benchmark_decontamination": 8, "pii": 8}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.schema["text"].dataType == docs.schema["text"].dataType
        assert counts[name] is None or after.count() == counts[name], name
        assert stage(spark, docs.limit(0), folder).count() == 0
    packed = STAGES["best_fit_packing"](spark, docs, folder).collect()
    assert len({r["doc_id"] for r in packed}) == 4 and sum(r["start"] == 0 for r in packed) == 8
    assert STAGES["best_fit_packing"](spark, docs.limit(0), folder).count() == 0
