import json
import lzma
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from florilege import sinks, streaming
from florilege.operators import trees
from florilege.sources import files, markup, paged, schemas

XML = """<?xml version="1.0"?><?xml-model type="x" href="a.rng"?><dic xmlns="http://www.tei-c.org/ns/1.0">
<entry xml:id="DLP-a_1-0a" volp="yes"><form><orth> casa  nova </orth></form><gramGrp>s.f.</gramGrp><sense xml:id="DLP-a_1-0a-1" n="1"><def>home</def></sense><xr><ref type="entry"> rua</ref></xr></entry>
<entry xml:id="DLP-b_1-0a" revised="2017-4-3"><form><orth>rua</orth></form></entry></dic>"""


@pytest.mark.parametrize("name", ["d.xml", "d.xml.xz"])
def test_xml_entries(spark, tmp_path, name):
    (tmp_path / name).write_bytes(lzma.compress(XML.encode()) if name.endswith("xz") else XML.encode())
    got = files.xml_entries(spark, str(tmp_path / name)).orderBy("entry_id").collect()
    assert [(r["entry_id"], r["orths"], [s["defs"] for s in r["senses"]], r["refs"], r["dates"], r["grams"]) for r in got] == [
        ("DLP-a_1-0a", ["casa nova"], [["home"]], [" rua"], [], ["s.f."]),
        ("DLP-b_1-0a", ["rua"], [], [], ["2017-4-3"], []),
    ]
    assert [tuple(r) for r in files.processing_instructions(spark, str(tmp_path / name), split=8).collect()] == [("href=a.rng | type=x", 1)]


def test_broken_xml_gives_what_came_before(spark, tmp_path):
    (tmp_path / "d.xml").write_text(XML[: XML.index("<entry xml:id=\"DLP-b") + 20])
    assert [r["entry_id"] for r in files.xml_entries(spark, str(tmp_path / "d.xml")).collect()] == ["DLP-a_1-0a"]
    errors = files.xml_errors(spark, str(tmp_path / "d.xml")).collect()
    assert len(errors) == 1 and errors[0]["path"].endswith("d.xml") and "ParseError" in errors[0]["error"]
    (tmp_path / "good.xml").write_text(XML)
    assert files.xml_errors(spark, str(tmp_path / "good.xml")).count() == 0
    (tmp_path / "cut.xml.xz").write_bytes(lzma.compress(XML.encode())[:-40])
    assert files.xml_errors(spark, str(tmp_path / "cut.xml.xz")).count() == 1


def test_definitions_and_ids_at_any_depth(spark, tmp_path):
    from florilege.rules import entries

    nested = '<dic><entry xml:id="DLP-a_1-0a"><form><orth>a</orth></form><sense xml:id="DLP-a_1-0a-1"><sense xml:id="odd id"><def>d</def></sense></sense></entry><entry xml:id="odd id"><form><orth>b</orth></form><sense xml:id="odd id-1"/></entry></dic>'
    (tmp_path / "n.xml").write_text(nested)
    found = entries.issues(files.xml_entries(spark, str(tmp_path / "n.xml"))).collect()
    by = lambda rule: sorted((r["entry_id"], r["evidence"]) for r in found if r["rule"] == rule)
    assert by("entrada_com_sentidos_sem_definicao") == [("odd id", "1")]
    assert by("xml_id_duplicado") == [("odd id", "2")]
    assert by("xml_id_fora_do_padrao_proposto") == [("DLP-a_1-0a", "odd id"), ("odd id", "odd id"), ("odd id", "odd id-1")]


def test_html(spark):
    page = '<h1>T <b>x</b></h1><p>One<br>two<a href="/a" title="t">l</a><img src="i.jpg" data-orig-file="o.jpg"><img src="o.jpg" alt="A"><script>no</script><div data-shortcode-data="1">z</div>'
    df = spark.createDataFrame([(1, page), (2, None)], "id long, html string")
    a, b = markup.contents(df, "id", "html").orderBy("id").collect()
    assert (a["text"], a["headings"], [x["href"] for x in a["links"]], [x["src"] for x in a["images"]], a["shortcodes"]) == ("T x\nOne\ntwol\nz", ["T x"], ["/a"], ["o.jpg"], 1)
    assert b["text"] == "" and b["word_count"] == 0
    nodes = trees.html_nodes(df, "id", "html").collect()
    assert {("", "h1", 1), ("h1", "b", 2)} <= {(r["above"], r["name"], r["depth"]) for r in nodes} and {r["id"] for r in nodes} == {1}


def test_tables(spark):
    page = '<table id="other"><tr><td>no</td></tr></table><table id="t"><tr><th>A</th><th>B</th></tr><tr><td>x<br>y</td><td><a href="u">l</a></td></tr><tr><td></td><td></td></tr></table>'
    df = spark.createDataFrame([(1, page)], "id long, html string")
    got = markup.table_rows(df, "id", "html", "t", ["A", "B"])
    assert [[c["text"] for c in r["cells"]] for r in got.orderBy("row").collect()] == [["x\ny", "l"], ["", ""]]
    assert markup.filled_rows(got).count() == 1
    with pytest.raises(PySparkException):
        markup.table_rows(df, "id", "html", "t", ["A", "C"]).collect()
    with pytest.raises(PySparkException):
        markup.table_rows(df, "id", "html", "t", ["A", "B"], longest=2).collect()


def test_json_in_pages_and_trees(spark):
    tree = {"id": 1, "metadata": {"y": 1}, "children": [{"id": 2, "children": [{"id": 3}]}, {"id": 4}]}
    df = spark.createDataFrame([(1, f"<script>var json = {json.dumps(tree)}; var app = 1</script>"), (2, "none"), (3, None)], "id long, page string")
    found = df.select("id", markup.after_marker("var json =")(F.col("page")).alias("tree"))
    assert [r["tree"] is None for r in found.orderBy("id").collect()] == [False, True, True]
    flat = markup.flattened(found, "id", "tree").orderBy("place").collect()
    assert [(r["node"], r["parent"], r["depth"]) for r in flat] == [("1", None, 1), ("2", "1", 2), ("3", "2", 3), ("4", "1", 2)]


def test_paged_scan(spark):
    def fetch(endpoint, page):
        if page == 3:
            raise OSError("gone")
        return [{"id": page}, {"id": page + 1}], 4

    records, skipped = paged.scan(spark, "posts", fetch, "id long", wait_s=0)
    assert [r["id"] for r in paged.without_repeats(records).orderBy("id").collect()] == [1, 2, 3, 4, 5]
    assert [(r["page"], r["error"]) for r in skipped.collect()] == [(3, "OSError: gone")]

    def broken(endpoint, page):
        raise OSError("down")

    with pytest.raises(OSError):
        paged.scan(spark, "posts", broken, "id long", wait_s=0)


def test_pages_are_tried_again_and_bugs_are_not_hidden():
    tries = []

    def fetch(endpoint, page):
        tries.append(page)
        if len(tries) < 3:
            raise ConnectionResetError("again")
        return [], 1

    assert paged.asked(fetch, "x", 5, wait_s=0) == ([], 1) and tries == [5, 5, 5]

    def wrong(endpoint, page):
        raise KeyError("a bug of the transport")

    with pytest.raises(KeyError):
        paged.asked(wrong, "x", 1, wait_s=0)


def test_followed_scans_go_on_where_they_ended(spark, tmp_path):
    """Each page is asked for once but for the first, whose answer tells how many there are; a failed first page ends the scan."""
    log = tmp_path / "log"

    def service(total, gone=()):
        def fetch(endpoint, page):
            with open(log, "a") as out:
                out.write(f"{page} ")
            if page in gone:
                raise OSError("gone")
            return [{"id": 10 * page + k} for k in range(3)], total

        return fetch

    state = str(tmp_path / "state")
    read = lambda total, **o: paged.followed(spark, "x", service(total, **o), "id long", state, attempts=1, wait_s=0)
    records, skipped = read(4, gone=(3,))
    assert sorted(r["id"] for r in records.collect()) == [10, 11, 12, 20, 21, 22, 40, 41, 42]
    assert [r["page"] for r in skipped.collect()] == [3]
    log.write_text("")
    records, skipped = read(6)
    assert sorted({r["page"] for r in records.collect()}) == [1, 2, 4, 5, 6] and records.count() == 15 and skipped.count() == 1
    assert set(log.read_text().split()) == {"1", "5", "6"}
    records, _ = read(6)
    assert records.count() == 15
    with pytest.raises(Exception, match="gone"):
        read(9, gone=(1,))
    assert read(7)[0].count() == 18


def test_crawls_that_do_not_end_fail(spark):
    docs = spark.createDataFrame([(f"m{k}", f"m{k + 1}", True) for k in range(5)], "url string, loc string, is_index boolean")
    with pytest.raises(ValueError, match="deeper"):
        paged.crawl(spark, ["m0"], docs, most_rounds=3)
    assert paged.crawl(spark, ["m0"], docs, most_rounds=6).count() == 0


def test_crawl(spark):
    docs = spark.createDataFrame([("r", "i1", True), ("r", "i1", True), ("i1", "p1", False), ("i1", "r", True), ("i1", "p2", False)], "url string, loc string, is_index boolean")
    assert sorted(r["url"] for r in paged.crawl(spark, ["r", "missing"], docs).collect()) == ["p1", "p2"]


def test_sheets_and_cache(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,,c\n1,2,3\n,,\n")
    got = files.sheet(spark, [str(tmp_path / "none.csv"), str(tmp_path / "s.csv")])
    assert got.columns == ["a", "Col2", "c"] and got.count() == 1
    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("id")
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "cache"), make).count() == 3
    assert len(made) == 1
    with pytest.raises(schemas.SchemaDrift):
        schemas.agreed(got, ["a", "b"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", é\nx'), (2, None), (3, "")], "id long, t string")
    assert sinks.csv_checked(df, str(tmp_path / "c")).count() == 3
    sinks.json_lines(df, str(tmp_path / "j"), ["id"])
    assert [r["t"] for r in files.json_snapshot(spark, str(tmp_path / "j"), "id long, t string").orderBy("id").collect()][0].startswith("a")
    sinks.csv_counts(df, str(tmp_path / "n"), [F.desc("id")])
    sinks.sheets({"x": df}, str(tmp_path / "book"), capped=("x",), rows=2)
    assert spark.read.parquet(str(tmp_path / "book/x")).count() == 2
    sinks.plan(df, str(tmp_path / "plan"), files.file_digests(spark, str(tmp_path / "n")))
    text = sinks.report("R", df, df, df, ("Do",))
    assert text.startswith("# R") and "- Do" in text
    assert [r["line"] for r in sinks.wiki_table(df, ["id", "t"]).collect()][1] == "| 2 || "


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:20:00")], "id long, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(source))
    stream = spark.readStream.schema("id long, at timestamp").parquet(str(source))
    write = streaming.journal(str(tmp_path / "journal"), "id")
    streaming.first_records(stream, "id", "at").writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "journal")).collect()) == [1, 2]
    write(spark.createDataFrame([(2, None), (3, None)], "id long, at timestamp"), 99)
    write(spark.createDataFrame([(2, None), (3, None)], "id long, at timestamp"), 99)
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "journal")).collect()) == [1, 2, 3]


def test_workbooks(spark, tmp_path):
    from florilege.sources import workbook

    a = spark.createDataFrame([(1, "x <&> é", None), (2, None, " b ")], "k long, t string, u string").orderBy("k")
    path = str(tmp_path / "w.xlsx")
    workbook.write(spark, {"A": a, 'B "q"': a.select("k"), "none": a.limit(0)}, f"file://{path}", rows=1)
    cells = workbook.read(spark, path)
    assert [tuple(r) for r in workbook.table_of(cells, "A").collect()] == [("1", "x <&> é", None)]
    assert {r["sheet"] for r in cells.collect()} == {"A", 'B "q"', "none"} and workbook.read(spark, path, ("A",)).count() == 2
    with pytest.raises(ValueError, match="no sheet"):
        workbook.table_of(cells, "other")
    assert [workbook._column(workbook._name(k) + "7") for k in (0, 25, 26, 701, 702)] == [0, 25, 26, 701, 702]


@pytest.fixture
def site():
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.answer(self.path != "/no-head", 405)

        def do_GET(self):
            self.answer(True, 405)

        def answer(self, allowed, refused):
            base = f"http://127.0.0.1:{self.server.server_port}"
            page = int(self.path.partition("&page=")[2][:1] or 0) if "posts" in self.path else 0
            bodies = {
                "/robots.txt": f"User-agent: *\nSitemap: {base}/maps.xml\n".encode(),
                "/maps.xml": f'<s xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc>{base}/one.xml</loc></sitemap><sitemap><loc>{base}/gone.xml</loc></sitemap></s>'.encode(),
                "/one.xml": f'<u xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> {base}/p1 </loc></url><url><loc>{base}/p2</loc></url></u>'.encode(),
                "/odd": b"ok \xff", "/no-head": b"here", "/%C3%A1": b"accent",
            }
            content = json.dumps([{"id": 2 * page}, {"id": 2 * page + 1}]).encode() if page else bodies.get(self.path)
            status = refused if not allowed else 404 if content is None else 200
            self.send_response(status)
            self.send_header("X-WP-TotalPages", "3")
            self.end_headers()
            if self.command == "GET" and content and status == 200:
                self.wfile.write(content)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_web(spark, site):
    from florilege.rules import site as rules
    from florilege.sources import web

    assert web.text(f"{site}/odd")[:2] == ("ok \ufffd", 200) and web.text(f"{site}/á#x")[0] == "accent"
    records, skipped = paged.scan(spark, "posts", web.pages(site, "id", 2, pause_s=0), "id long", wait_s=0)
    assert sorted(r["id"] for r in records.collect()) == [2, 3, 4, 5, 6, 7] and skipped.count() == 0
    assert web.site_map(site) == [f"{site}/p1", f"{site}/p2"]
    links = spark.createDataFrame([(f"{site}{p}",) for p in ("/odd", "/no-head", "/gone", "/odd")] + [("http://127.0.0.1:9/x",), (None,)], "url string")
    got = {r["url"].removeprefix(site): (r["status"], r["error"] is None) for r in web.checked(links, 5, 0, 2).collect()}
    assert got == {"/odd": (200, True), "/no-head": (200, True), "/gone": (404, True), "http://127.0.0.1:9/x": (None, False)}
    bad = rules.broken_links(web.checked(links, 5, 0, 2))
    assert sorted(r["url"].removeprefix(site) for r in bad.collect()) == ["/gone", "http://127.0.0.1:9/x"]
    read = {r["url"].removeprefix(site): (r["text"], r["error"] is None) for r in web.texts(spark, [f"{site}/odd", f"{site}/gone"]).collect()}
    assert read == {"/odd": ("ok \ufffd", True), "/gone": (None, False)}
    assert web.parameters(web.address(site, "posts", a=1, b=None, c="é")) == {"a": "1", "c": "é"}


def test_stored_tables_are_cleared(spark):
    from florilege.operators import stored

    stored.clear(spark)
    kept = stored.stored(spark.range(3), "kept")
    path = kept.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(path) and stored.clear(spark) == 1 and not os.path.exists(path) and stored.clear(spark) == 0


def test_listings_are_written_in_parts(spark):
    def fetch(token):
        at = int(token or 0)
        return [f"i{k}" for k in range(at, min(at + 3, 11))], str(at + 3) if at + 3 < 11 else None

    listed = paged.continued(spark, fetch, held=4)
    assert [r["id"] for r in listed.orderBy("place").collect()] == [f"i{k}" for k in range(11)]
    assert paged.continued(spark, lambda token: ([], None)).count() == 0
    with pytest.raises(ValueError):
        paged.continued(spark, lambda token: (["x"], "again"), most=3)


def test_sheets_in_a_workbook_are_replaced(spark, tmp_path):
    from florilege.sources import workbook

    path = f"file://{tmp_path}/b.xlsx"
    df = lambda *values: spark.createDataFrame([(v,) for v in values], "v string").coalesce(1)
    workbook.write(spark, {"a": df("1"), "b & c": df("2", "3")}, path)
    workbook.replace(spark, path, {"b & c": df("x<y")})
    workbook.replace(spark, path, {"new": df("n"), "newer": df("m"), "a": df("1", None)})
    cells = workbook.read(spark, path)
    assert [(r["sheet"], r["row"], r["cells"]) for r in cells.orderBy("sheet", "row").collect()] == [("a", 1, ["v"]), ("a", 2, ["1"]), ("b & c", 1, ["v"]), ("b & c", 2, ["x<y"]), ("new", 1, ["v"]), ("new", 2, ["n"]), ("newer", 1, ["v"]), ("newer", 2, ["m"])]


def test_site_maps_without_end_fail(site):
    from florilege.sources import web

    with pytest.raises(ValueError, match="maps"):
        web.site_map(site, most=1)
