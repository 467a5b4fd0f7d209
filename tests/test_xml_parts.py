"""The splittable XML source against whole-file parsing: every split size, cut anywhere, damaged files, bounded memory."""

import gzip
import io
import json
import lzma
import random
import re
import subprocess
import zlib
from xml.etree import ElementTree

import pytest

from florilege.sinks import xmlfiles
from florilege.sources import files, xmlparts

NS = 'xmlns="urn:t" xmlns:m=\'urn:m\''


def document(rng, n, decoys=True):
    """decoys: tags in comments, in CDATA sections and within one another, which a part that begins among them can't tell."""
    parts = [f"<?xml version='1.0' encoding='utf-8'?><!-- {'<entry>' * decoys} --><!DOCTYPE dic [<!ENTITY x 'y'>]>\n<dic {NS} a='>'>"]
    for k in range(n):
        inner = rng.choice(["", "é😀" * rng.randrange(20), "<m:meta m:s='1'/>", "<entryless/>", "a &lt;entry&gt; b"] + ["<entry id='in'>x</entry>", "<!-- </entry> <entry> -->", "<![CDATA[</entry><entry>]]>"] * decoys)
        parts.append(rng.choice(["", "\n  ", "<other>entry</other>", "<?xml-model  href='a.rng' type=\"x\"?>"] + ["<!-- <entry/> -->", "<m:x><![CDATA[<entry>]]></m:x>"] * decoys))
        parts.append(rng.choice([f"<entry id='{k}' t='a>b/'>{inner}</entry >", f"<entry\nid='{k}'/>", f"<m:entry id='{k}'>{inner}</m:entry>", f"<entry id='{k}' xmlns:m='urn:own'>{inner}</entry>"]))
    return "".join(parts) + "</dic>\n<!-- end -->"


def outer(text):
    """Entries that aren't inside another, as (attributes, what they hold), by a parser that reads all."""
    found = []

    def walk(node):
        if node.tag.rpartition("}")[2] == "entry":
            found.append(ElementTree.canonicalize(ElementTree.tostring(node, "unicode").rstrip()))
        else:
            for child in node:
                walk(child)

    root = ElementTree.fromstring(text)
    for node in root.iter():
        node.tail = None
    walk(root)
    return found


def packed(data, kind, rng, size):
    cuts = [data[k : k + size] for k in range(0, len(data), size)]
    if kind == "blocks.xz":
        return b"".join(xmlfiles.xz_parts(iter(cuts)))
    if kind == "streams.xz":
        return b"".join(lzma.compress(c) + b"\0" * 4 * rng.randrange(2) for c in cuts)
    if kind == "members.gz":
        return b"".join(gzip.compress(c) + b"\0" * rng.randrange(3) for c in cuts)
    return data


def rows_of(data, path, split, tag="entry", what="elements", begins="{}"):
    class Files:
        def open_input_file(self, _):
            return io.BytesIO(data)

    reader = xmlparts.XmlPartsReader({"path": path, "tag": tag, "what": what, "split": split, "begins": begins})
    out = []
    original = xmlparts.opened
    xmlparts.opened = lambda uri: (Files(), uri)
    try:
        for start in range(0, max(1, len(data)), split):
            out += list(reader._rows(path, len(data), start))
    finally:
        xmlparts.opened = original
    return out


@pytest.mark.parametrize("kind", ["plain.xml", "blocks.xz", "streams.xz", "members.gz"])
def test_every_split_gives_each_element_once(kind, monkeypatch):
    monkeypatch.setattr(xmlparts, "CHUNK", 97)
    rng = random.Random(3)
    for trial in range(16):
        decoys = trial % 2 == 0
        text = document(rng, 25, decoys)
        expected = outer(text)
        data = packed(text.encode(), kind, rng, rng.choice([50, 333, 5000]))
        for split in (1 << 20,) if decoys else (31, 200, 1 << 20):
            rows = rows_of(data, kind, split)
            assert [r["error"] for r in rows] == [None] * len(expected), (trial, split, rows[-1])
            assert [ElementTree.canonicalize(ElementTree.tostring(ElementTree.fromstring(r["xml"]), "unicode")) for r in rows] == expected
            models = rows_of(data, kind, split, "xml-model", "instructions")
            assert [r["xml"] for r in models] == re.findall(r"<\?xml-model\s+(.*?)\?>", text)


def test_files_of_other_writers(tmp_path):
    text = document(random.Random(8), 400, False)
    (tmp_path / "d.xml").write_text(text)
    made = subprocess.run(["xz", "-k", "--block-size=4096", str(tmp_path / "d.xml")], capture_output=True)
    if made.returncode:
        pytest.skip("no xz")
    data = (tmp_path / "d.xml.xz").read_bytes()
    assert len(xmlparts.xz_blocks(io.BytesIO(data), len(data))) > 3
    for split in (500, 3000, 1 << 20):
        assert [r["error"] for r in rows_of(data, "d.xml.xz", split)] == [None] * len(outer(text))


def test_what_the_sink_writes_others_read():
    rng = random.Random(1)
    chunks = [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 5000))) for _ in range(30)]
    assert lzma.decompress(b"".join(xmlfiles.xz_parts(iter(chunks)))) == gzip.decompress(b"".join(xmlfiles.gz_parts(iter(chunks)))) == b"".join(chunks)
    assert lzma.decompress(b"".join(xmlfiles.xz_parts(iter([])))) == b""


@pytest.mark.parametrize("kind", ["plain.xml", "blocks.xz", "streams.xz", "members.gz"])
def test_cut_files_are_reported(kind):
    text = "<dic>" + "".join(f"<entry id='{k}'>{'x' * 50}</entry>" for k in range(60)) + "</dic>"

    class Unpadded:
        randrange = staticmethod(lambda n: 0)

    data = packed(text.encode(), kind, Unpadded, 700)
    for cut in (1, 7, 40, len(data) // 2):
        for split in (300, 1 << 20):
            rows = rows_of(data[:-cut], kind, split)
            assert [r["error"] for r in rows if r["error"]], (cut, split)
            ids = [re.search("id='(\\d+)'", r["xml"])[1] for r in rows if r["xml"]]
            assert ids == [str(k) for k in range(len(ids))] and len(ids) >= (0 if split == 300 else 1)
    flipped = bytearray(data)
    flipped[len(data) // 2] ^= 0xFF
    assert kind == "plain.xml" or any(r["error"] for r in rows_of(bytes(flipped), kind, 1 << 20))


def test_memory_follows_an_element_not_a_file(monkeypatch):
    """One block that unpacks to 60 MB is read with a window of some chunks."""
    seen = []
    original = xmlparts.Window.pull

    def pull(self):
        seen.append(len(self.data))
        return original(self)

    monkeypatch.setattr(xmlparts.Window, "pull", pull)
    text = b"<dic>" + b"<entry>" + b"x" * 2000 + b"</entry>" + b" " * 60_000_000 + b"<entry/></dic>"
    for kind, data in (("a.xz", lzma.compress(text, preset=0)), ("a.gz", zlib.compress(text, 1, 31))):
        assert len(rows_of(data, kind, 1 << 20)) == 2
    assert max(seen) < 4 * xmlparts.CHUNK


@pytest.mark.parametrize("suffix", ["", ".xz", ".gz"])
def test_folders_patterns_and_empty_tables(spark, tmp_path, suffix):
    df = spark.createDataFrame([(f"<entry id='e{k}'>é</entry>",) for k in range(500)] + [(None,)], "x string").repartition(3)
    listed = xmlfiles.write(df, str(tmp_path / "out"), suffix, "<dic xmlns:m='urn:m'>", "</dic>", block_bytes=300)
    assert listed.agg({"elements": "sum"}).first()[0] == 500
    for path in (tmp_path / "out", f"{tmp_path}/o*", f"{tmp_path}/out/part-*.xml{suffix}"):
        got = files.xml_entries(spark, str(path), split=1000)
        assert sorted(r["entry_id"] for r in got.select("entry_id").collect()) == sorted(f"e{k}" for k in range(500))
    assert files.xml_errors(spark, str(tmp_path / "out")).count() == 0
    assert files.xml_entries(spark, f"{tmp_path}/out/none-*").count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        files.xml_entries(spark, str(tmp_path / "missing")).count()
    broken = spark.createDataFrame([("<entry id='a'><b></entry>",), ("<entry id='c'/>",)], "x string").coalesce(1)
    xmlfiles.write(broken, str(tmp_path / "broken"), suffix)
    assert [r["entry_id"] for r in files.xml_entries(spark, str(tmp_path / "broken")).collect()] == ["c"]
    assert "ParseError" in files.xml_errors(spark, str(tmp_path / "broken")).first()["error"]


@pytest.mark.parametrize("kind", ["plain.xml", "blocks.xz", "streams.xz", "members.gz"])
def test_ranges_that_begin_inside_of_comments_sections_and_elements(kind, monkeypatch):
    monkeypatch.setattr(xmlparts, "CHUNK", 97)
    rng = random.Random(4)
    inside = 0
    for _ in range(12):
        text = document(rng, 20)
        data = packed(text.encode(), kind, rng, rng.choice([7, 50, 333]))
        for split in (5, 31, 200):
            passages = rows_of(data, kind, split, what="passages")
            begins = xmlparts._begins([(r["path"], r["part"], r["xml"]) for r in passages], split)
            inside += len(begins)
            rows = rows_of(data, kind, split, begins=json.dumps(begins))
            assert [r["error"] for r in rows] == [None] * len(rows)
            assert [ElementTree.canonicalize(ElementTree.tostring(ElementTree.fromstring(r["xml"]), "unicode")) for r in rows] == outer(text)
    assert inside > 50


@pytest.mark.parametrize("suffix", ["", ".xz", ".gz"])
def test_read_knows_what_a_range_begins_inside_of(spark, tmp_path, suffix):
    lines = [f"<!-- <entry> {'x' * (k % 90)} --><entry id='{k}'><entry>{k}</entry></entry>" for k in range(300)]
    xmlfiles.write(spark.createDataFrame([(x,) for x in lines], "x string").repartition(2), str(tmp_path / "out"), suffix, block_bytes=70)
    got = xmlparts.read(spark, str(tmp_path / "out"), "entry", split=150).collect()
    assert sorted(r["xml"] or r["error"] for r in got) == sorted(x.partition("-->")[2] for x in lines)
