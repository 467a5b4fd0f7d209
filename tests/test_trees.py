"""Range joins, node tables and axes against brute force; the queries over pages and texts that have no SQL."""

import html
import random
import re
from collections import Counter
from pathlib import Path
from xml.etree import ElementTree

import pytest

from florilege import catalogue
from florilege.operators import ranges, trees

DATA = Path("/root/testdata/sf0.001")


def test_ranges_against_brute_force(spark):
    rng = random.Random(1)
    intervals = [(k, rng.choice("xy"), a := rng.choice([0, rng.randrange(60), rng.randrange(5000)]), a + rng.choice([-1, 0, 1, rng.randrange(20), rng.randrange(3000)])) for k in range(150)]
    points = [(100 + k, rng.choice("xyz"), rng.choice([rng.randrange(80), rng.randrange(8000)]), rng.choice("pq")) for k in range(300)]
    left = spark.createDataFrame(intervals, "id long, level string, low long, high long")
    right = spark.createDataFrame(points, "other long, level string, place long, kind string")
    expected = sorted((i, p) for i, a, low, high in intervals for p, b, place, _ in points if a == b and low <= place <= high)
    got = ranges.pairs_within(left, right, ["level"], "low", "high", "place")
    assert sorted((r["id"], r["other"]) for r in got.select("id", "other").collect()) == expected
    kinds = {p: kind for p, _, _, kind in points}
    counted = ranges.counts_within(left, right, ["level"], "low", "high", "place", ["kind"])
    assert {(r["id"], r["kind"]): r["n"] for r in counted.collect()} == Counter((i, kinds[p]) for i, p in expected)
    assert ranges.pairs_within(left.limit(0), right, ["level"], "low", "high", "place").count() == 0
    for low, high in ((0, 0), (5, 4), (3, 17), (0, 1023), (7, 7)):
        tiles = ranges.tiled(spark.createDataFrame([(low, high)], "low long, high long"), "low", "high", "k", "b").collect()
        covered = sorted(x for t in tiles for x in range(t["b"] << t["k"], (t["b"] + 1) << t["k"]))
        assert covered == list(range(low, high + 1)) and len(tiles) <= 2 * (high - low + 2).bit_length()


def random_tree(rng, depth=0):
    name = rng.choice(["a", "b", "m:a", "m:c"])
    inner = "".join(random_tree(rng, depth + 1) + rng.choice(["", " t ", "&lt;"]) for _ in range(rng.randrange(4) if depth < 5 else 0))
    return f"<{name} {rng.choice(['', 'x=" 1"', 'm:x="2"', 'xml:id="i"'])}>{rng.choice(['', 'text  here'])}{inner}</{name}>"


def test_nodes_and_axes_against_brute_force(spark):
    rng = random.Random(4)
    texts = [f'<root xmlns="urn:d" xmlns:m="urn:m">{"".join(random_tree(rng) for _ in range(4))}</root>' for _ in range(6)]
    docs = spark.createDataFrame([*enumerate(texts), (99, None), (98, "")], "doc long, xml string")
    nodes = trees.xml_nodes(docs, "doc", "xml").cache()
    rows = {(r["doc"], r["pre"]): r for r in nodes.collect()}
    expected, below, parent_of = {}, {}, {}
    for k, text in enumerate(texts):
        root = ElementTree.fromstring(text)
        order = list(root.iter())
        place = {id(x): i for i, x in enumerate(order)}
        for x in order:
            own = (x.text or "") + "".join(c.tail or "" for c in x)
            space, _, local = x.tag[1:].rpartition("}")
            expected[k, place[id(x)]] = (local, space, ("m:" if space == "urn:m" else "") + local, " ".join(own.split()), len(x.attrib))
            below[k, place[id(x)]] = {place[id(y)] for y in x.iter()} - {place[id(x)]}
            for c in x:
                parent_of[k, place[id(c)]] = place[id(x)]
    assert {key: (r["local"], r["namespace"], r["name"], r["text"], len(r["attributes"])) for key, r in rows.items()} == expected
    assert {key: r["parent"] for key, r in rows.items() if r["parent"] >= 0} == parent_of
    assert any("m:x" in r["attributes"] for r in rows.values()) and any("xml:id" in r["attributes"] for r in rows.values())
    assert all(r["depth"] == 1 + sum(r["pre"] in below[key[0], p] for p in range(r["pre"])) for key, r in rows.items())
    every = [(k, a, b) for k in range(6) for a in range(10_000) if (k, a) in rows for b in range(10_000) if (k, b) in rows]
    rule = {
        "child": lambda k, a, b: parent_of.get((k, b)) == a,
        "parent": lambda k, a, b: parent_of.get((k, a)) == b,
        "descendant": lambda k, a, b: b in below[k, a],
        "ancestor": lambda k, a, b: a in below[k, b],
        "following-sibling": lambda k, a, b: a < b and parent_of.get((k, a), -1) == parent_of.get((k, b), -1) != -1,
        "preceding-sibling": lambda k, a, b: b < a and parent_of.get((k, a), -1) == parent_of.get((k, b), -1) != -1,
        "following": lambda k, a, b: a < b and b not in below[k, a],
        "preceding": lambda k, a, b: b < a and a not in below[k, b],
    }
    for axis, holds in rule.items():
        found = [(r["doc"], r["a_pre"], r["b_pre"]) for r in trees.related(nodes, nodes, axis, "doc", "name").collect()]
        assert sorted(found) == [x for x in every if holds(*x)], axis
    for axis in ("descendant", "following"):
        found = {(r["doc"], r["a_pre"], r["b_name"]): r["n"] for r in trees.related_counts(nodes, nodes, axis, "doc").collect()}
        assert found == Counter((k, a, rows[k, b]["name"]) for k, a, b in every if rule[axis](k, a, b))
    one = trees.related(nodes.where("name = 'm:a'"), nodes.where("name = 'b'"), "descendant", "doc", "depth")
    assert one.columns == ["doc", "a_pre", "b_pre", "a_depth", "b_depth"]
    with pytest.raises(ValueError):
        trees.related(nodes, nodes, "self", "doc")


def test_long_documents_are_parsed_in_pieces():
    inner = "".join(f"<b>{k}</b> t{k} " for k in range(20_000))
    nodes = list(trees.numbered(trees.xml_events(f"<a>{inner}</a>")))
    assert len(nodes) == 20_001 and nodes[-1]["last"] == 20_000 and nodes[-1]["text"].split()[-1] == "t19999"
    page = list(trees.numbered(trees.html_events(f"<a>{inner}")))
    assert [(n["pre"], n["last"], n["text"]) for n in page] == [(n["pre"], n["last"], n["text"]) for n in nodes]


def documents(name):
    import pyarrow.parquet as pq

    return pq.read_table(DATA / f"{name}.parquet").to_pylist()


needs_data = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


@needs_data
def test_tag_pairs_against_patterns(spark):
    expected = Counter()
    for page in documents("pages"):
        bare = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|(?<=<script>).*?(?=</script>)|(?<=<style>).*?(?=</style>)", "", page["html"] or "")
        path = []
        for closing, name in re.findall(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>", bare):
            name = name.lower()
            if closing:
                if name in path:
                    del path[len(path) - 1 - path[::-1].index(name) :]
            else:
                expected[path[-1] if path else "", name, len(path) + 1] += 1
                if name not in ("br", "img", "meta", "hr", "input", "link"):
                    path.append(name)
    got = {(r["parent"], r["tag"], r["depth"]): r["n"] for r in catalogue.QUERIES["tag_pairs"](spark, str(DATA)).collect()}
    assert got == expected and len(got) > 20


@needs_data
def test_parsed_contents_against_patterns(spark):
    got = {r["page_id"]: r for r in catalogue.QUERIES["parsed_contents"](spark, str(DATA)).collect()}
    for page in documents("pages"):
        text = page["html"] or ""
        bare = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<script\b.*?</script>|<style\b.*?</style>", "", text)
        attributes = [(name.lower(), dict(re.findall(r'([a-z-]+)="([^"]*)"', rest))) for name, rest in re.findall(r"<([a-zA-Z][a-zA-Z0-9]*)([^>]*)>", bare)]
        words = html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"(?i)</?(?:br|p|div|li|tr|h[1-6])\b[^>]*>", "\n", bare))).split()
        r = got[page["page_id"]]
        assert (r["links"], r["headings"], r["word_count"], r["html_length"]) == (sum(n == "a" and bool(a.get("href")) for n, a in attributes), sum(n in ("h1", "h2", "h3") for n, _ in attributes), len(words), len(text))
        assert r["images"] == len({a["src"] for n, a in attributes if n == "img" and a.get("src")}) and r["shortcodes"] == 0


@needs_data
def test_writing_issues_against_plain_rules(spark):
    import unicodedata

    expected = Counter()
    for doc in documents("documents"):
        raw = doc["text"] or ""
        if not raw.strip():
            continue
        visible = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", raw))).split())
        plain = re.sub("[^a-z0-9]+", " ", "".join(c for c in unicodedata.normalize("NFKD", visible.lower()) if not unicodedata.combining(c)))
        rules = {
            "encoding": re.search("�|Ã[\x80-\xbf]", raw),
            "double space": re.search(r"\s{2,}", raw),
            "repeated word": re.search(r"\b(\w{4,})\s+\1\b", raw, re.I),
            "repeated punctuation": re.search(r"([!?.,;:])\1", raw),
            "unbalanced brackets": raw.count("(") != raw.count(")") or raw.count("[") != raw.count("]"),
            "odd underscore": re.search(r"\w_[\s/)]|_$|__", raw.strip()),
            "visible markup": re.search(r"<[^>]+>|&lt;|&gt;", raw),
            "tripled letter": re.search(r"([a-z])\1\1", plain),
        }
        expected.update((name, "Alta" if name in ("encoding", "repeated word") else "Média") for name, found in rules.items() if found)
    got = {(r["evidence"], r["severity"]): r["n"] for r in catalogue.QUERIES["writing_issues"](spark, str(DATA)).collect()}
    assert got == expected and len(got) >= 3


def test_counts_while_reading_equal_those_of_joins(spark):
    """No node is made a row; the pairs of related() are the measure."""
    xml = ['<a xmlns:m="urn:m" k="1"><m:b xml:id="x"/><c><m:b/><c><d m:k="2"/></c></c><m:b/></a>', '<a><a><b/></a><b xmlns="urn:n"><c/></b></a>', None, ""]
    docs = spark.createDataFrame(list(enumerate(xml)), "key long, xml string")
    nodes = trees.xml_nodes(docs, "key", "xml").cache()
    expected = []
    for axis in ("child", "following-sibling", "descendant", "ancestor", "following"):
        pairs = trees.related(nodes, nodes, axis, "key", "name")
        expected += [(axis, *r) for r in pairs.groupBy("a_name", "b_name").count().collect()]
    got = trees.axis_counts(docs, "xml")
    assert sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) > 30
    counted = trees.structure_counts(docs, "xml")
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, trees.structure(nodes).collect()))
    for df in (got, counted):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("MapInArrow") <= 2


def test_pages_are_parsed_a_few_at_a_time(spark, monkeypatch):
    """What a task holds doesn't grow with the rows of a batch."""
    import pandas as pd

    from florilege.sources import markup

    frames = list(markup._few(iter([pd.DataFrame({"k": range(250)}), pd.DataFrame({"k": []})])))
    assert [len(f) for f in frames] == [100, 100, 50, 0] and frames[1]["k"].tolist() == list(range(100, 200))
    pages = spark.range(250).selectExpr("id", "concat('<h1>t</h1><a href=x>', id, '</a>') AS html").coalesce(1)
    got = markup.contents(pages, "id", "html").collect()
    assert [(r["id"], r["text"], len(r["links"])) for r in got] == [(k, f"t\n{k}", 1) for k in range(250)]
