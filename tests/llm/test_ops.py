"""Operators against brute force, exact round trips, held-out accuracy, and the edge cases their docstrings define."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from florilege.llm import components, decontamination, embeddings, html_text, jaccard, language, packing, pii, secrets, shingles, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def frame(spark, texts, **columns):
    rows = [(k, t, None, None, None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# -- HTML


def test_html_is_forgiving():
    model = html_text.default_model()
    text = lambda page: html_text.extract(page, dict(model.own), dict(model.tie))
    page = "<html><head><title>T</title><script>var a='</p>'</script></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class='ad'>Buy now!</div><article><h1>Head &amp; more</h1><p>First  para,\n with words and more of them. It goes on.<p>Second &eacute; para, also with words. &lt;b&gt; stays.<br>line</article><footer>&copy; me</footer></body></html>"
    assert text(page) == "Head & more\nFirst para, with words and more of them. It goes on.\nSecond é para, also with words. <b> stays. line"
    for odd in ("", "<", "<p", "<a href='", "</x></y>", "<!-- open", "<script>never closed", "plain", "<table><td>" * 50):
        assert isinstance(text(odd), str)


def test_html_marginals_are_exact():
    """Sum-product against enumeration of all labelings of a small tree."""
    from itertools import product
    from math import exp

    model = html_text.default_model()
    tree = html_text.parse("<div class=ad><a href=x>l</a></div><article><p>some words, here.</p></article>")
    own, tie = html_text.features(tree)
    got, _ = model.marginals(tree, own, tie)
    n = len(tree.tags)
    total, content = 0.0, [0.0] * n
    for labels in product((0, 1), repeat=n - 1):
        y = (0, *labels)
        score = sum(model.own.get(f, 0.0) for i in range(1, n) if y[i] for f in own[i]) + sum(model.tie[f][2 * y[tree.parents[i]] + y[i]] for i in range(1, n) for f in tie[i] if f in model.tie)
        total += exp(score)
        for i in range(n):
            content[i] += y[i] * exp(score)
    assert np.allclose(got[1:], [c / total for c in content[1:]])


def test_html_held_out_pages():
    model, right, every = html_text.default_model(), 0, 0
    for page, mark in html_text.labelled_pages(40, seed=5):
        tree = html_text.parse(page)
        truth = [0] * len(tree.tags)
        for i in range(1, len(truth)):
            said = tree.hints[i] & {mark, f"{mark}out"}
            truth[i] = int(mark in said) if said else truth[tree.parents[i]]
        tree.hints = [h - {mark, f"{mark}out"} for h in tree.hints]
        content, _ = model.marginals(tree, *html_text.features(tree))
        right += sum((c >= 0.5) == t for c, t in zip(content[1:], truth[1:], strict=True))
        every += len(truth) - 1
    assert right / every > 0.95


def test_html_query_edges(spark):
    pages = spark.createDataFrame([(1, "u", None, 5), (1, "u", "", 5), (None, None, "<article><h1>Words here</h1><p>More words, and more of them.</p></article>", 6)], "page_id long, url string, html string, text int")
    got = html_text.main_text(pages).collect()
    text = "Words here\nMore words, and more of them."
    assert sorted(((r["page_id"] or 0, r["n_chars"], r["text"]) for r in got)) == [(0, len(text), text), (1, 0, ""), (1, 0, "")]
    parted = html_text.extract("<article><h1>Head line &amp; so</h1><p>One &am<b>p;</b> two &lt;b&gt; and &eacute;<i>t&eacute;</i>, words of a sentence.</p></article>", dict(html_text.default_model().own), dict(html_text.default_model().tie))
    assert parted == "Head line & so\nOne &amp; two <b> and été, words of a sentence."
    assert html_text.main_text(pages.limit(0)).count() == 0


# -- secrets


def test_secret_base_rules():
    text = 'password = "abcdef1" TOKEN:abc api-key apikey=zzzzzz password=token=abcdefgh AKIA' + "A1" * 8 + " AKIAX " + "0a" * 12 + " é password=ſecret9"
    spans = secrets.base_spans(text)
    assert [(secrets.KINDS[k], text[a:b]) for a, k, b in spans] == [("assign", 'password = "abcdef1'), ("assign", "apikey=zzzzzz"), ("assign", "password=token=abcdefgh"), ("access", "AKIA" + "A1" * 8), ("hex", "0a" * 12)]


def test_secret_novelty(spark):
    rng = random.Random(3)
    fresh = "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(40))
    repeated = "config_value_name_2 " * 3
    texts = [f"auth header Bearer {fresh} end", f"the key {repeated} auth config_value_name_2", f"nothing here {fresh}", None, "", "x" * 200_000, "token = 'abcdef' " * 2000]
    rows = secrets.find(frame(spark, texts)).orderBy("doc_id").collect()
    assert rows[0]["spans"] == f"novel:{texts[0].index(fresh)}:{texts[0].index(fresh) + 40}" and rows[0]["n_novel"] == 1
    assert [r["n_novel"] for r in rows[1:]] == [0] * 6
    assert rows[3]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[6]["n_assign"] == 2000
    assert secrets.find(frame(spark, [])).count() == 0


# -- decontamination


def test_decontamination_against_brute_force(spark):
    rng = random.Random(1)
    items = [words(rng, n) for n in (30, 25, 12, 6, 2)]
    items.append(items[0])
    leak = lambda t, k: " ".join("xx" if i % k == k - 1 else w for i, w in enumerate(t.split()))
    texts = [f"{words(rng, 40)} {items[0]} {words(rng, 10)}", f"{words(rng, 20)} {leak(items[1], 6)}!", words(rng, 300), items[3].upper(), None, "", f"{items[4]} {words(rng, 9)}", f"{words(rng, 5)} {' '.join(items[0].split()[4:28])}", items[2]]
    docs = frame(spark, texts)
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, items[0]), (9, None)], "item_id long, text string")
    split = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    expected = set()
    distinct = {}
    for k, t in enumerate(items):
        distinct.setdefault(tuple(split(t)), k)
    for d, t in enumerate(texts):
        own = split(t)
        for item, k in distinct.items():
            size = min(decontamination.WINDOW, len(item))
            for shift in range(-len(item), len(own)):
                for begin in range(len(item) - size + 1):
                    agree = sum(0 <= j + shift < len(own) and own[j + shift] == item[j] for j in range(begin, begin + size))
                    if agree >= decontamination.SHARE * size - 1e-9:
                        expected.add((d, k))
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find(docs, bench).collect()}
    assert got == expected and {d for d, _ in got} >= {0, 1, 3, 6, 7, 8}
    assert got == {(r["doc_id"], r["item_id"]) for r in decontamination.find(docs, bench, broadcast_seeds=0).collect()}
    kept = decontamination.clean(docs.withColumn("_extra", F.lit(1)), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(range(9)) - {d for d, _ in got}) and "_extra" in kept.columns
    assert decontamination.find(docs.limit(0), bench).count() == decontamination.find(docs, bench.limit(0)).count() == 0


# -- WARC


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(2)
    big = "".join(chr(rng.randrange(32, 0x2000)) for _ in range(300_000))
    html = ["<p>a</p>", "<p>a</p>", "", None, big, "\x1f\x8b\x08 magic WARC/1.1", "<p>a</p>"] + [words(rng, 500) for _ in range(60)]
    pages = spark.createDataFrame([(k, None if k == 2 else f"http://x.org/é {k}\r\n", h) for k, h in enumerate(html)], "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    files = warc.write(pages, folder, file_bytes=40_000)
    got = {r["page_id"]: r for r in warc.read(files, folder, split_bytes=7_001).collect()}
    assert len(got) == len(html) == warc.read(files, folder).count() and files.count() > 3
    for k, h in enumerate(html):
        payload = (h or "").encode()
        first = min(j for j, x in enumerate(html) if (x or "") == (h or ""))
        r = got[k]
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if k == first else ("revisit", first))
        assert k != first or r["payload"] == payload
    import gzip

    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "warc").glob("*.gz")))
    assert raw.count(b"WARC/1.1\r\nWARC-Type") == len(html)
    ties = spark.createDataFrame([(None, None, "same"), (5, "u", "same"), (5, "u", "same")], "page_id long, url string, html string")
    kinds = sorted((r["record_type"], str(r["refers_to"])) for r in warc.round_trip(spark, ties, f"file://{tmp_path}/ties").collect())
    assert kinds == [("response", "None"), ("response", "None"), ("revisit", "5")]
    assert warc.round_trip(spark, ties.limit(0), f"file://{tmp_path}/none").count() == 0


# -- components and embeddings


def reach(ids, edges):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r["id"]: r["component_id"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = reach({x for e in edges for x in e}, edges)
    assert all(got.get(i, i) == c for i, c in expected.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 12))
    x = np.concatenate([base, base[:20] + rng.normal(scale=0.1, size=(20, 12)), base[:5], base[5:9] * 3, np.repeat(base[:1], 30, 0)]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    other = rng.normal(size=(30, 5)).astype(np.float32)
    other[10:20] = other[:10] * 2 + 0.01
    rows += [(2000 + k, v.tolist()) for k, v in enumerate(other)]
    rows += [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [None] + [1.0] * 11), (1004, [1.0]), (None, x[0].tolist()), (1005, [float("inf")] * 12), (1006, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name in ("label", "rep", "n", "d", "n_links", "component_id", "kept", "p", "q"):
        df = df.withColumn(name, F.lit(1))
    for block in (10, 8192):
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(df, block=block).collect() if r["vec_id"] is not None}
        y = x.astype(np.float64)
        unit = y / np.linalg.norm(y, axis=1, keepdims=True)
        links = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
        comp = reach(range(len(x)), zip(*np.nonzero(links), strict=True))
        for k in range(len(x)):
            assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (links[k].sum(), comp[k], comp[k] == k)
        assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k for k in range(1000, 1007))
        unit = other / np.linalg.norm(other.astype(np.float64), axis=1, keepdims=True)
        links = (unit @ unit.T >= 0.9) & ~np.eye(30, dtype=bool)
        assert [got[2000 + k]["n_links"] for k in range(30)] == links.sum(1).tolist() and links.sum() >= 20
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_in_doubles(spark):
    """Vectors that single precision can't tell from the threshold."""
    angle = np.arccos(0.9)
    rows = [(1, [1.0, 0.0]), (2, [float(np.cos(angle + 1e-9)), float(np.sin(angle + 1e-9))]), (3, [float(np.cos(-angle + 1e-9)), float(np.sin(-angle + 1e-9))])]
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_boxes_prune_clusters():
    """Blocks of clusters that are far apart aren't compared."""
    low, high = np.array([[0.9, 0.0, 0.0], [0.0, 0.9, 0.0], [0.8, 0.0, 0.0]]), np.array([[1.0, 0.1, 0.3], [0.1, 1.0, 0.3], [0.9, 0.3, 0.5]])
    blocks = embeddings.Blocks({0: 10, 1: 25, 2: 5}, low, high, 10, 0.9)
    assert [blocks.partners(p).tolist() for p in range(5)] == [[0, 4], [1, 2, 3], [1, 2, 3], [1, 2, 3], [0, 4]]
    assert set(blocks.of(np.array([0, 1, 1, 1, 1, 2]), np.arange(6)).tolist()) <= {0, 1, 2, 3, 4}


# -- Jaccard


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def planted(rng):
    texts = []
    common = words(rng, 60)
    for _ in range(25):
        texts.append(words(rng, rng.randrange(30, 120)))
    for k in range(8):
        base = words(rng, 80).split()
        for j in range(rng.randrange(2, 12)):
            w = base.copy()
            for _ in range(rng.randrange(0, 1 + k)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(w if j % 3 else w[: 80 - 2 * j]))
    texts += [f"{words(rng, 15)} {common}", f"{common} {words(rng, 18)}", f"{common} {words(rng, 30)}", common, common.upper()]
    return [*texts, None, "", " \t\n", "one two", "One  two", "one two three", "é x y z q r", "É x y z q r"]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_against_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    texts = planted(rng)
    rng.shuffle(texts)
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    expected = reach(range(len(texts)), links)
    for name, value in (("FREQUENT", 4), ("BLOCK", 3), ("COUNTED", 2)):
        monkeypatch.setattr(jaccard, name, value)
    docs = frame(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.group(docs).collect()}
    assert got == {k: (len(sets[k]), expected[k]) for k in range(len(texts))}
    kept = jaccard.keep_one(docs.unionByName(docs.limit(3)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, c in expected.items() if k == c) and kept.columns == docs.columns


def test_jaccard_edges(spark):
    assert jaccard.group(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f"), (9, None)], "doc_id long, text string").withColumn("n", F.lit(1))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.group(rows).collect()) == [("2", 2, "2"), ("3", 2, "2"), ("3", 2, "2"), ("9", 0, "9"), ("None", 2, "None")]
    row, code = shingles.sets(pa.array(["a b c d e", "a b", None, "a b c d e a b c d e"]))
    assert np.bincount(row, minlength=4).tolist() == [1, 1, 0, 5] and len(code) == 7


def test_jaccard_ids_that_clash(spark):
    rng = random.Random(21)
    base, other, third = words(rng, 60), words(rng, 60), words(rng, 60)
    rows = [(5, base, "a"), (5, other, "b"), (7, other + " x", "c"), (3, third, "d"), (9, third, "e"), (3, third, "d"), (3, third + " y", "f"), (8, "", "g"), (8, None, "h"), (None, base, "i"), (4, base + " z", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("_sig", "_SIG_", "cls", "rep", "root", "component", "_kept"):
        docs = docs.withColumn(name, F.lit(1))
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in jaccard.group(docs).collect())
    assert got == [("3", 3), ("3", 3), ("3", 3), ("4", 4), ("5", 4), ("5", 5), ("7", 5), ("8", 8), ("8", 8), ("9", 3), ("None", None)]
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    sources = sorted(r["source"] for r in kept.collect())
    assert sources in (list("bdghij"), list("bfghij"))  # of both sets of document 3 the one of smaller number
    assert sorted(r["source"] for r in jaccard.keep_one(docs.where("source IN ('a', 'c', 'd', 'e', 'j', 'g', 'i')")).collect()) == list("cdgij")


def test_levels_and_passes(spark, monkeypatch):
    """Few slots, low thresholds and further passes change the order of shingles, never the links."""
    for name, value in (("FREQUENT", 2), ("COUNTED", 1), ("EXACT", 40), ("LEVELS", 1 << 11), ("DENSE", 0), ("HELD_ROWS", 3), ("BROADCAST_ROWS", 5)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(5)
    texts = planted(rng)
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    expected = reach(range(len(texts)), links)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.group(frame(spark, texts)).collect()} == expected
    counted = spark.createDataFrame([(5, 2), (1 << 62, 9), (-7, 300)], "token long, times long")
    asked = np.array([5, 1 << 62, -7, 1 << 61], np.int64).view(np.uint64)
    assert jaccard.Levels.of(counted)(asked).tolist() == [1, 3, 8, 0]
    monkeypatch.setattr(jaccard, "EXACT", 1)
    levels = jaccard.Levels.of(counted)
    assert len(levels.tokens) == 1 and levels(asked).tolist() == [1, 3, 8, 0]


def test_shared_streams_runs():
    rng = random.Random(6)
    rows = sorted((rng.randrange(30), k, 0, rng.choice((1, 1, 1, 2)) if k % 3 else 1, 9) for k in range(400))
    names = ["token", "cls", "group", "comp", "n"]
    table = pa.table(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))
    mixed = {t for t in range(30) if len({r[3] for r in rows if r[0] == t}) > 1}
    for size in (1, 7, 400):
        got = [tuple(r[n] for n in names) for b in jaccard.shared(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert got == [r for r in rows if r[0] in mixed]


def test_matrix_links():
    import pandas as pd

    rng = random.Random(3)
    base = words(rng, 50)
    frame_ = pd.DataFrame({"side": [0, 0, 1, 1], "cls": [1, 2, 10, 11], "text": [base, words(rng, 40), base + " x", words(rng, 50)]})
    assert jaccard.matrix_links(frame_).values.tolist() == [[10, 1]]


# -- toxicity and language


def test_toxicity_learns_and_keeps_folds(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        text = words(rng, 40)
        rows.append((k, text + (" you idiot scum" if toxic else "")))
        labels.append((k, 1, int(toxic)))
    rows += [(9999, None), (9998, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", F.lit(7))
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(model[0]) < 2000 and len(got) == 602
    for k in range(600):
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert got[k]["predicted"] == int(k % 5 == 0)
    assert 0 <= got[9999]["score"] == got[9998]["score"] <= 1
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_language(spark):
    rng = random.Random(7)
    syllables = {"aa": ["ba", "bo", "bi", "lu"], "bb": ["krz", "szt", "ch", "ow"], "cc": ["ção", "ões", "nh", "lh"]}
    make = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    rows = [(k, make(lang, rng.randrange(8, 60)), lang) for k in range(300) for lang in [rng.choice(list(syllables))]]
    rows += [(900, None, "aa"), (901, "12 ++", "aa"), (902, make("aa", 20), None), (903, "我们 的 语言 是 中文 大家 好", None), (None, make("bb", 30), "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    truth = {k: lang for k, _, lang in rows if k is not None and k < 900}
    assert sum(got[k]["lang_pred"] == lang for k, lang in truth.items()) / len(truth) > 0.98
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0.0
    assert got[902]["lang_pred"] == "aa" and got[903]["rejected"] and all(0 <= r["score"] <= 1 for r in got.values())
    kept = language.keep_known(docs)
    assert {r["doc_id"] for r in kept.collect()} == {*truth, 902, None} and kept.columns == docs.columns
    assert {r["lang_pred"] for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).count() == 0


# -- PII


def luhn_ok(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_pii(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(re.sub(r"\D", "", v)) <= 19 and luhn_ok(re.sub(r"\D", "", v))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub(r"\D", "", v)) <= 15),
    }
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, (p, keep) in kinds.items() for m in re.finditer(p, text or "", re.ASCII) if keep(m.group()))


def test_pii_against_brute_force(spark):
    rng = random.Random(8)
    bits = ["a.b+c@x-y.co.uk", "a@b.co_x@y.zz", "a@b", "@x.y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "1 2 3", "12 34", "+351 21 123 4567", "+1 (555) 123-4567.", "+12", "+1+22334455667", "é𝒳", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "GB82WEST12345698765433", "word", "", "-", " ", "\n", "99999999999999999999999999.1.1.1"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(1, 14))) for _ in range(300)] + [None, "", "7" * 30_000, "a" * 30_000 + "@", ("x@y.zz " * 400)]
    got = pii.find(frame(spark, texts)).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        base = brute_pii(t)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), t
        assert ",".join(x for x in r["spans"].split(",") if x and not x.startswith("iban")) == base
        assert len(r["scores"]) == len([x for x in r["spans"].split(",") if x])
    text = "My iban GB82 WEST 1234 5698 7654 32. Mail a@b.org, or é@x 4111 1111 1111 1111"
    docs = frame(spark, [text, None, "clean"]).withColumn("_spans", F.lit(0))
    out = [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()]
    assert out == ["My iban [IBAN]. Mail [EMAIL], or é@x [CARD]", None, "clean"] and pii.redact(docs).where("_spans = 0").count() == 3 and pii.redact(docs).columns == docs.columns
    assert pii.find(frame(spark, [])).count() == pii.redact(frame(spark, [])).count() == 0


def test_pii_many_spans_and_clashing_columns(spark):
    many = "é a@b.org, " * 1500
    docs = frame(spark, [many, "card 4111 1111 1111 1111, 1.2.3.4", "1.2.3.4 is the host", "1.2.3.4 " + "x" * 60 + " host"])
    for name in ("spans", "cut", "found", "Spans_", "_pii_email", "scores", "n_email"):
        docs = docs.withColumn(name, F.lit(name))
    rows = pii.find(docs).orderBy("doc_id").collect()
    assert rows[0]["n_email"] == 1500 and rows[0]["spans"] == ",".join(f"email:{11 * k + 2}:{11 * k + 9}" for k in range(1500))
    assert rows[0]["scores"] == [0.7] * 1500 and rows[1]["scores"] == [0.5, 0.8] and rows[2]["scores"] == [0.7] and rows[3]["scores"] == [0.5]
    out = pii.redact(docs).orderBy("doc_id").collect()
    assert out[0]["text"] == "é [EMAIL], " * 1500 and out[1]["text"] == "card [CARD], [IP]" and out[0]["_pii_email"] == "_pii_email" and out[0]["spans"] == "spans"


# -- packing


TOKENIZER = None


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("word_bpe_49k.json"))


def test_encoder_is_exact():
    t = tokenizer()
    rng = random.Random(9)
    texts = ["", "It's 12 ½² ok", "ÉTÉ ß İ ǅ", "a<|endoftext|>b", "tab\tnew\nline", "é combining", "中文 text", "x" * 3000, "Σίσυφος", "\x1f odd \x85 space　", words(rng, 3000), "l'été c'est d'une"]
    texts += ["".join(rng.choice("aéß'’12 -_.\n ñÇ🙂") for _ in range(rng.randrange(60))) for _ in range(200)]
    encode = packing.Encoder(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    for _ in range(2):
        for text, ids in zip(texts, encode(texts), strict=True):
            assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1], text


def test_packing(spark):
    t = tokenizer()
    rng = random.Random(10)
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(120)] + [words(rng, 900), None, "", words(rng, 10)]
    docs = frame(spark, texts).unionByName(frame(spark, texts).where("doc_id = 3"))
    rows = packing.pack(docs, capacity=256, shard_pieces=40).collect()
    ids = {k: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for k, x in enumerate(texts)}
    bins, seen = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 256 * r["piece"] and r["length"] == len(part) <= 256 and r["ids_crc32"] == zlib.crc32(part.tobytes())
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert seen == {k: len(v) * (2 if k == 3 else 1) for k, v in ids.items()}
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= 256
    least = -(-sum(seen.values()) // 256)
    assert len(bins) <= 1.06 * least + 1
    assert packing.pack(frame(spark, [])).count() == 0


def test_encoder_forgets_and_stays_exact():
    t = tokenizer()
    rng = random.Random(12)
    texts = [f"x{c}y {c}Z 1{c}2 {c}'s {c}" for c in map(chr, range(1, 0x260))] + ["''s's 's't'rex've'lly 'd'D'M don't -'s .'re", "'"]
    texts += ["".join(rng.choice("aeéß'’12 -_.\n ñÇ×÷stremvld'") for _ in range(rng.randrange(80))) for _ in range(500)]
    encode = packing.Encoder(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"), entries=100)
    for k in range(0, len(texts), 100):
        for text, ids in zip(texts[k : k + 100], encode(texts[k : k + 100]), strict=True):
            assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1], text
    assert len(encode.known) < 1200


def test_islands_beat_best_fit(spark):
    """Sizes that best-fit decreasing packs into one sequence more than needed."""
    rng = random.Random(4)
    sizes = [rng.randint(20, 100) for _ in range(120)]
    fit = packing.seeded(sizes, 150, random.Random(0), 0.0)
    items = spark.createDataFrame([(k, 0, 0, n, 0, k) for k, n in enumerate(sizes)], packing.PIECES)
    placed = packing.evolve_islands(items, 0, 150, 2, 3, 60, 10_000).collect()
    fills = {}
    for r in placed:
        fills[r["bin"]] = fills.get(r["bin"], 0) + r["length"]
    assert sorted(r["row_id"] for r in placed) == list(range(120)) and max(fills.values()) <= 150
    assert len(fills) == -(-sum(sizes) // 150) == len(fit[0]) - 1


def test_packing_edges(spark):
    docs = spark.createDataFrame([(None, "one two"), (1, None), (1, "word " * 30_000), (1, "word " * 30_000)], "doc_id long, text string")
    for name in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset", "row_id", "shard", "bin"):
        docs = docs.withColumn(name, F.lit("x"))
    rows = packing.pack(docs).collect()
    assert sorted(r["length"] for r in rows) == sorted([3, 1, *[4096, 4096, 4096, 4096, 4096, 4096, 4096, 1329] * 2])
    assert len({r["sequence_id"] for r in rows}) == 15 and sum(r["doc_id"] is None for r in rows) == 1


def test_crossover_keeps_every_item():
    rng = random.Random(11)
    sizes = [rng.randrange(1, 100) for _ in range(200)]
    a, b = packing.seeded(sizes, 128, rng, 0.0), packing.seeded(sizes, 128, rng, 0.5)
    for _ in range(20):
        child = packing.crossover(a, b, sizes, 128, rng)
        assert sorted(i for x in child[0] for i in x) == list(range(200))
        assert all(f == sum(sizes[i] for i in x) <= 128 for x, f in zip(*child, strict=True))
        a = child
    assert packing.fitness(packing.evolve(sizes, [a, b], 128, 5, rng)) <= min(packing.fitness(a), packing.fitness(b))
