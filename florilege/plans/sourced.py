"""Sources and sinks end to end: what is written from the record tables is read again through a source."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege import sinks
from florilege.functions import text, urls
from florilege.operators import catalog
from florilege.operators.stored import shared_dir, stored
from florilege.plans import sqltext as q
from florilege.plans.words import CORPUS_TYPOS, tokens
from florilege.registry import query, table
from florilege.sinks import xmlfiles
from florilege.sources import files, markup, paged, workbook, xmlparts
from florilege.sources.schemas import agreed


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/florilege/{name}-{uuid.uuid4().hex}"


@query("X1", f"SELECT page_id, sha256({q.strip_html('html')}) AS visible FROM pages")
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(text.strip_html(F.col("html")).cast("binary"), 256).alias("visible"))


@query("P1 P3 P8 S15 S17 K1", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS title, c_mktsegment AS type FROM customer")
def nested_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON with a title that may be missing, read with the agreed schema, flattened."""
    title = F.when(F.col("c_custkey") % 3 != 0, F.struct(F.col("c_name").alias("rendered")))
    path = _place(spark, "records")
    sinks.json_lines(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), title.alias("title"), F.col("c_mktsegment").alias("type"), F.lit("raw").alias("raw_cells")), path)
    records = spark.read.schema("id long, title struct<rendered:string>, type string, raw_cells string").json(path)
    return records.drop("raw_cells").select("id", F.coalesce("title.rendered", F.lit("")).alias("title"), "type")


@query("F8 X34", "SELECT event_id, 'https://img.example.org/e/' || event_id || '.jpg' AS address FROM events WHERE event_type IN ('click', 'view')")
def allowed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id").cast("string")
    url = F.when(F.col("event_type") == "click", F.concat(F.lit("http://IMG.example.org/e/"), key, F.lit(".jpg?w=9#x"))).when(F.col("event_type") == "view", F.concat(F.lit("https://img.example.org/e/"), key, F.lit(".jpg")))
    url = url.when(F.col("event_type") == "error", F.concat(F.lit("https://other.org/"), key, F.lit(".jpg"))).when(F.col("event_type") == "signup", F.concat(F.lit("/e/"), key, F.lit(".jpg"))).otherwise(F.concat(F.lit("https://img.example.org/e/"), key, F.lit(".html")))
    rows = table(spark, sf_dir, "events").select("event_id", url.alias("url"))
    return rows.where(urls.is_image(F.col("url"), ("img.example.org",))).select("event_id", urls.image_address(F.col("url")).alias("address"))


@query("X31", "SELECT page_id, regexp_replace(url, '[?#].*$', '') || '/%C3%A1%20b%2Fc?q=%C3%BC%20x&c=~' AS address FROM pages")
def safe_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages with a path and a query that need encoding."""
    odd = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/á b%252Fc;v=1?q=%C3%BC x&c=%7E#f"))
    return table(spark, sf_dir, "pages").select("page_id", urls.safe(odd).alias("address"))


_TRIPLES = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")


def _spelling_candidates(texts: DataFrame) -> DataFrame:
    words = texts.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    return words.where(text.is_slug_candidate(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@query("F12 X4", f"SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE len(word) >= 8 OR regexp_matches(word, '{_TRIPLES}') GROUP BY word")
def slug_spelling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelling_candidates(table(spark, sf_dir, "documents"))


@query("X12 J1", f"""SELECT w.doc_id, w.word, t.meant, count(*) AS n FROM (SELECT doc_id, unnest(string_split_regex({q.fold("coalesce(text, '')")}, '[^a-z]+')) AS word FROM documents) w JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in CORPUS_TYPOS)}) AS t(word, meant) USING (word) GROUP BY 1, 2, 3""")
def known_typos(spark: SparkSession, sf_dir: str) -> DataFrame:
    meant = spark.createDataFrame(CORPUS_TYPOS, "word string, meant string")
    return tokens(table(spark, sf_dir, "documents")).join(F.broadcast(meant), "word").groupBy("doc_id", "word", "meant").agg(F.count("*").alias("n"))


@query("P10 S14 X44", "SELECT r_regionkey AS region, place, node, CASE WHEN place > 1 THEN 'r' || r_regionkey END AS parent FROM (SELECT r_regionkey, 1 AS place, 'r' || r_regionkey AS node FROM region UNION ALL SELECT n_regionkey, 1 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 'n' || n_nationkey FROM nation)")
def flattened_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: F.struct(F.concat(F.lit("n"), k.cast("string")).alias("id"))).alias("children"))
    trees = children.select(F.col("n_regionkey").alias("region"), F.to_json(F.struct(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("id"), "children")).alias("tree"))
    return markup.flattened(trees, "region", "tree").select("region", "place", "node", "parent")


@query("S11 F9 Q38", "SELECT s_nationkey AS nation, s_suppkey // 500 AS part, row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 500 ORDER BY s_suppkey) AS row, s_name AS name, CAST(s_suppkey AS VARCHAR) AS code FROM supplier")
def scanned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of suppliers by nation and by hundreds of their keys, so that a page has a bounded number of rows."""
    row = F.struct("s_suppkey", F.concat(F.lit("<tr><td> "), "s_name", F.lit("</td><td><a href='x'>"), F.col("s_suppkey").cast("string"), F.lit("</a></td></tr>")).alias("h"))
    key = (F.col("s_nationkey") + 1000 * F.floor(F.col("s_suppkey") / 500)).alias("page")
    tables = table(spark, sf_dir, "supplier").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["h"]), "").alias("rows"))
    pages = tables.select("page", F.concat(F.lit("<p>x</p><table id='t'><tr><th>A</th><th>B</th></tr>"), "rows", F.lit("</table>")).alias("html"))
    cells = markup.filled_rows(markup.table_rows(pages, "page", "html", "t", ["A", "B"]))
    return cells.select((F.col("page") % 1000).alias("nation"), F.floor(F.col("page") / 1000).alias("part"), "row", F.get("cells", 0)["text"].alias("name"), F.get("cells", 1)["text"].alias("code"))


@query("S12 S13 W5")
def parsed_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markup.contents(table(spark, sf_dir, "pages"), "page_id", "html")
    return found.select("page_id", F.size("links").alias("links"), F.size("images").alias("images"), F.size("headings").alias("headings"), "word_count", "html_length", "shortcodes")


@query("S7 K2 O5", "SELECT 'nations' AS sheet, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation UNION ALL (SELECT 'customers', CAST(c_custkey AS VARCHAR), c_name FROM customer ORDER BY c_custkey LIMIT 200)")
def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook of three sheets, one of them capped; two are read again by their names."""
    path = f"{_place(spark, 'workbook')}.xlsx"
    pick = lambda name, key, label: table(spark, sf_dir, name).select(F.col(key).alias("key"), F.col(label).alias("name")).orderBy("key")
    workbook.write(spark, {"nations": pick("nation", "n_nationkey", "n_name"), "regions": pick("region", "r_regionkey", "r_name"), "customers": pick("customer", "c_custkey", "c_name")}, path, rows=200)
    cells = workbook.read(spark, path, ("nations", "customers"))
    found = [workbook.table_of(cells, name).select(F.lit(name).alias("sheet"), "key", "name") for name in ("nations", "customers")]
    return found[0].unionByName(found[1])


@query("S7 K3", "SELECT 'nations' AS sheet, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'regions', CAST(r_regionkey AS VARCHAR), r_name FROM region UNION ALL (SELECT 'suppliers', CAST(s_suppkey AS VARCHAR), s_name FROM supplier ORDER BY s_suppkey LIMIT 300)")
def replaced_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook in which one sheet is replaced and one is added, while one stays as it was."""
    path = f"{_place(spark, 'workbook')}.xlsx"
    pick = lambda name, key, label: table(spark, sf_dir, name).select(F.col(key).alias("key"), F.col(label).alias("name")).orderBy("key")
    nations = pick("nation", "n_nationkey", "n_name")
    workbook.write(spark, {"nations": nations, "regions": pick("region", "r_regionkey", "r_name")}, path)
    some = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).orderBy("key")
    workbook.replace(spark, path, {"nations": some, "suppliers": pick("supplier", "s_suppkey", "s_name")}, rows=300)
    cells = workbook.read(spark, path)
    found = [workbook.table_of(cells, name).select(F.lit(name).alias("sheet"), "key", "name") for name in ("nations", "regions", "suppliers")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("K5 K6", "SELECT r_regionkey, r_name FROM region")
def written_and_read_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "sheet")
    sinks.csv_checked(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), path)
    rows = agreed(files.sheet(spark, [f"{path}-none", path]), ["r_regionkey", "r_name"])
    return rows.select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@query("K2 K3 S4 O5", "(SELECT p_partkey, p_brand FROM part ORDER BY p_partkey, p_brand LIMIT 500)")
def capped_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _place(spark, "book")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    for _ in range(2):  # a sheet that is written again is replaced
        sinks.sheets({"parts": parts}, folder, capped=("parts",), rows=500)
    return files.cached(spark, f"{folder}/parts", lambda: parts)


@query("K7 A23", "SELECT c_custkey AS k, c_name AS name FROM customer")
def written_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import plan of all customers beside the digests of its inputs, read back."""
    path, book = _place(spark, "plan"), _place(spark, "inputs")
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    sinks.csv_checked(wanted, book)
    sinks.plan(wanted, path, files.file_digests(spark, book))
    return spark.read.schema("k long, name string").json(f"{path}/plan")


#: Orders on a page of the offline service; every seventh page from the fourth on never comes.
PER_PAGE = 250
_NUMBERED_SQL = f"n AS (SELECT o_orderkey, o_totalprice, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // {PER_PAGE} + 1 AS BIGINT) AS page FROM orders)"


def _order_pages(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """(folder, page of each order) of a service with the orders, by key."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"))
    return _place(spark, "service"), stored(catalog.paginated(orders, ["id"], PER_PAGE).drop("place"), "order-pages")


@query("S1 S3 W6", f"WITH {_NUMBERED_SQL}, l AS (SELECT max(page) AS last FROM n) SELECT o_orderkey AS id, o_totalprice AS total, CAST(NULL AS BIGINT) AS skipped FROM n, l WHERE page % 7 <> 4 OR page = last OR ((SELECT max(o_orderkey) FROM n AS x WHERE x.page = n.page) = o_orderkey AND ((page + 1) % 7 <> 4 OR page + 1 = last)) UNION ALL SELECT NULL, NULL, page FROM n, l WHERE page % 7 = 4 AND page < last GROUP BY page")
def paged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by pages, each of which begins with the last record of the page before; some pages never come and are listed. The
    last page always comes, as it tells how many there are."""
    folder, numbered = _order_pages(spark, sf_dir)
    last = numbered.agg(F.max("page")).first()[0]
    ends = numbered.groupBy("page").agg(F.max(F.struct("id", "total")).alias("r")).select("r.id", "r.total", (F.col("page") + 1).alias("page")).where(F.col("page") <= last)
    served = numbered.unionByName(ends).where((F.col("page") % 7 != 4) | (F.col("page") == last))
    served.repartition("page").write.partitionBy("page").json(f"{folder}/orders")
    records, skipped = paged.scan(spark, "orders", paged.folder_pages(spark, folder), "id long, total double", attempts=2, wait_s=0)
    listed = paged.without_repeats(records).select("id", "total", F.lit(None).cast("long").alias("skipped"))
    return listed.unionByName(skipped.select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("total"), F.col("page").alias("skipped")))


@query("S5 M5", f"WITH {_NUMBERED_SQL} SELECT o_orderkey AS id, page, CAST(1 AS BIGINT) AS n FROM n")
def resumed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same service read by a stream that ends after a third of the pages, is started again while more pages are added, and
    once more: how often each order came, and from which page."""
    folder, numbered = _order_pages(spark, sf_dir)
    last = numbered.agg(F.max("page")).first()[0] or 0
    fetch, state = paged.folder_pages(spark, folder), _place(spark, "followed")
    steps = [0, max(1, last // 3), max(1, 2 * last // 3), max(1, last)]
    for low, high in zip(steps, steps[1:], strict=False):
        new = numbered.where((F.col("page") > low) & (F.col("page") <= high))
        new.repartition("page").write.mode("append").partitionBy("page").json(f"{folder}/orders")
        records, _ = paged.followed(spark, "orders", fetch, "id long, total double", state, wait_s=0)
    return records.groupBy("id", "page").agg(F.count("*").alias("n"))


@query("S16 W4", "SELECT CAST(b AS BIGINT) AS batch, string_agg('Q' || c_custkey, '|' ORDER BY c_custkey) AS ids FROM (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 50 AS b FROM customer) GROUP BY b")
def entity_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of customers, listed 400 at a time by a token, in batches of fifty."""
    folder = _place(spark, "listing")
    customers = catalog.paginated(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 400)
    ids = customers.select("page", "place", F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("id"))
    ids.repartition("page").sortWithinPartitions("page", "place").select("page", "id").write.partitionBy("page").json(folder)
    return paged.batches(paged.continued(spark, paged.folder_tokens(spark, folder), held=1000))


@query("S2", "SELECT c_custkey, c_name || '�é' AS name FROM customer")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as bytes with one that is no UTF-8."""
    content = F.concat(F.col("c_name").cast("binary"), F.unhex(F.lit("FF")), F.lit("é").cast("binary"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.decoded(content).alias("name"))


@query("S14 X44", "SELECT page_id, '{\"id\": ' || page_id || ', \"t\": [1, \"}\"]}' AS value FROM pages WHERE page_id % 3 <> 0")
def embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON after a marker in a script, with what would end it inside a string; some pages have none that can be read."""
    value = F.concat(F.lit('<script>var json =  {"id":'), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, F.lit(",,")).otherwise(F.lit(', "t": [1,"}"]}; var app = 1;</script>')))
    found = table(spark, sf_dir, "pages").select("page_id", markup.after_marker("var json =")(F.concat("html", value)).alias("value"))
    return found.where("value IS NOT NULL")


@query("S6 U4 U5", "SELECT n_name AS url FROM nation WHERE n_regionkey > 0")
def crawled_site_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root index, which robots.txt names, of region indexes of nations; the first region can't be reached."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    name = lambda c: F.concat(F.lit("region-"), F.col(c).cast("string"))
    root = region.select(F.lit("root").alias("url"), name("r_regionkey").alias("loc"), F.lit(True).alias("is_index"))
    below = nation.where("n_regionkey > 0").select(name("n_regionkey").alias("url"), F.col("n_name").alias("loc"), F.lit(False).alias("is_index"))
    back = region.select(name("r_regionkey").alias("url"), F.lit("root").alias("loc"), F.lit(True).alias("is_index")).where("url <> 'region-0'")
    return paged.crawl(spark, paged.roots("https://site.org", "User-agent: *\nSitemap: root\n"), root.unionByName(below).unionByName(back))


@query("S9 S8", "SELECT DISTINCT 'DLP-e_1-' || conv_id AS entry_id, 'Lema ' || conv_id AS lemma FROM conversations")
def xml_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written as a few XML files and read by Spark's own reader."""
    key = F.col("conv_id").cast("string")
    line = F.concat(F.lit('<entry id="DLP-e_1-'), key, F.lit('" volp="yes"><form><orth>Lema '), key, F.lit('</orth></form><sense n="1"><def>d</def></sense></entry>'))
    path = _place(spark, "xml")
    lines = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 16).alias("part"), F.lit(1).alias("place"), line.alias("value")).distinct()
    # a file per part: what opens and closes it stands around its lines, which are sorted, not gathered
    frame = [lines.select("part").distinct().select("part", F.lit(k).alias("place"), F.lit(v).alias("value")) for k, v in ((0, "<dic>"), (2, "</dic>"))]
    whole = lines.unionByName(frame[0]).unionByName(frame[1]).repartition("part").sortWithinPartitions("part", "place")
    whole.select("part", "value").write.partitionBy("part").text(path)
    rows = files.xml_rows(spark, f"{path}/part=*/*.txt", "entry", "_id string, _volp string, form struct<orth:string>")
    return rows.select(F.col("_id").alias("entry_id"), F.col("form.orth").alias("lemma"))


_SPLIT_SQL = "SELECT kind, conv_id, turn, role, sha256(coalesce(text, '')) AS digest FROM conversations, (VALUES ('.xz'), ('.gz'), ('')) AS t(kind)"


@query("S8 S10 K1 X42", _SPLIT_SQL)
def split_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations written as XML in blocks of .xz, members of .gz and plain, which cut elements anywhere, and read by ranges."""
    turn = table(spark, sf_dir, "conversations")
    attribute = lambda name, c: F.concat(F.lit(f' {name}="'), F.col(c).cast("string"), F.lit('"'))
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\r"), F.lit("&#13;"))
    line = F.concat(F.lit("<!-- <entry> --><entry"), attribute("m:conv", "conv_id"), attribute("n", "turn"), attribute("role", "role"), F.lit("><form><orth>"), escaped(F.coalesce("text", F.lit(""))), F.lit("</orth></form></entry>\n"))
    found = []
    for kind in (".xz", ".gz", ""):
        path = _place(spark, "split-xml")
        xmlfiles.write(turn.select(line), path, kind, '<dic xmlns="http://www.tei-c.org/ns/1.0" xmlns:m="urn:m">', "</dic>", block_bytes=1 << 16)
        rows = xmlparts.read(spark, path, "entry", split=1 << 17)
        of = lambda name: F.xpath_string("xml", F.lit(f"/*/@*[local-name()='{name}']"))
        text_of = F.xpath_string("xml", F.lit("/entry/form/orth"))
        # an error would come as a row of nulls
        found.append(rows.select(F.lit(kind).alias("kind"), of("conv").cast("long").alias("conv_id"), of("n").cast("long").alias("turn"), of("role").alias("role"), F.sha2(text_of.cast("binary"), 256).alias("digest")))
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("S8 S10 X43", "SELECT 'href=a.rng | type=x' AS signature, count(DISTINCT conv_id % 4) AS n FROM conversations")
def xml_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing instructions of a few XML files, a file per remainder."""
    path = _place(spark, "instructions")
    lines = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 4).alias("part")).distinct().select("part", F.lit('<?xml-model type="x" href="a.rng"?><dic/>').alias("value"))
    lines.write.partitionBy("part").text(path)
    return files.processing_instructions(spark, f"{path}/part=*/*.txt")


@query("K11 X18", "SELECT '| ' || p_partkey || ' || ' || p_name AS line FROM part")
def wiki_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.wiki_table(table(spark, sf_dir, "part"), ["p_partkey", "p_name"])
