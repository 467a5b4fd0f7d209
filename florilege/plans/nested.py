"""Trees: axes and structure of XML that is made of orders, and nested JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions import hashing, text
from florilege.operators import trees
from florilege.operators.stored import shared_dir, stored
from florilege.registry import query, table
from florilege.rules import grammar
from florilege.sinks import xmlfiles
from florilege.sources import xmlparts


def _order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(xml): an element per order, written in blocks of .xz and read again; items are in order of their line and part.

    An order has few lines; they are gathered in its row.
    """
    lines = table(spark, sf_dir, "lineitem")
    item = F.concat(F.lit('<o:item n="'), F.col("l_linenumber").cast("string"), F.lit('"><part>'), F.col("l_partkey").cast("string"), F.lit('</part><m:cost><m:tax rate="'), F.col("l_tax").cast("string"), F.lit('"/></m:cost></o:item>'))
    items = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_tax", item.alias("x")))).alias("items"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    inner = F.coalesce(F.concat(F.lit("<items>"), F.array_join(F.transform("items", lambda i: i["x"]), ""), F.lit("</items>")), F.lit(""))
    head = F.concat(F.lit("<head><status>"), "o_orderstatus", F.lit("</status>"), F.when(F.col("o_orderkey") % 3 == 0, F.lit('<m:urgent xml:id="u"/>')).otherwise(""), F.lit("</head>"))
    line = F.concat(F.lit('<order key="'), F.col("o_orderkey").cast("string"), F.lit('">'), head, inner, F.lit("</order>"))
    path = f"{shared_dir(spark)}/florilege/orders-{uuid.uuid4().hex}"
    xmlfiles.write(orders.select(line), path, ".xz", '<orders xmlns:o="urn:order" xmlns:m="urn:money">', "</orders>")
    return xmlparts.read(spark, path, "order").select("xml")


#: A node per row with its place among its document's: k orders the nodes of a document as they stand in it.
_NODES_SQL = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_tax) AS i FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
h AS (SELECT DISTINCT l_orderkey AS key FROM l),
n AS (SELECT o_orderkey AS key, '' AS up, 'a' AS id, 'order' AS name, '' AS ns, 1 AS depth, ['key'] AS attrs FROM orders
UNION ALL SELECT o_orderkey, 'a', 'ab', 'head', '', 2, [] FROM orders UNION ALL SELECT o_orderkey, 'ab', 'abc', 'status', '', 3, [] FROM orders
UNION ALL SELECT o_orderkey, 'ab', 'abd', 'm:urgent', 'urn:money', 3, ['xml:id'] FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT key, 'a', 'ac', 'items', '', 2, [] FROM h
UNION ALL SELECT l_orderkey, 'ac', 'ac' || lpad(CAST(i AS VARCHAR), 9, '0'), 'o:item', 'urn:order', 3, ['n'] FROM l
UNION ALL SELECT l_orderkey, 'ac' || lpad(CAST(i AS VARCHAR), 9, '0'), 'ac' || lpad(CAST(i AS VARCHAR), 9, '0') || 'a', 'part', '', 4, [] FROM l
UNION ALL SELECT l_orderkey, 'ac' || lpad(CAST(i AS VARCHAR), 9, '0'), 'ac' || lpad(CAST(i AS VARCHAR), 9, '0') || 'b', 'm:cost', 'urn:money', 4, [] FROM l
UNION ALL SELECT l_orderkey, 'ac' || lpad(CAST(i AS VARCHAR), 9, '0') || 'b', 'ac' || lpad(CAST(i AS VARCHAR), 9, '0') || 'bc', 'm:tax', 'urn:money', 5, ['rate'] FROM l)"""


@query("X42 A1", f"""WITH RECURSIVE {_NODES_SQL},
d(key, above, id, outer_name, inner_name) AS (SELECT a.key, a.id, b.id, a.name, b.name FROM n AS a JOIN n AS b ON a.key = b.key AND b.up = a.id UNION ALL SELECT d.key, d.above, n.id, d.outer_name, n.name FROM d JOIN n ON d.key = n.key AND n.up = d.id),
f AS (SELECT a.name AS outer_name, b.name AS inner_name, count(*) AS n FROM n AS a JOIN n AS b ON a.key = b.key AND b.id > a.id WHERE NOT starts_with(b.id, a.id) GROUP BY ALL)
SELECT 'child' AS axis, a.name AS outer_name, b.name AS inner_name, count(*) AS n FROM n AS a JOIN n AS b ON a.key = b.key AND b.up = a.id GROUP BY ALL
UNION ALL SELECT 'descendant', outer_name, inner_name, count(*) FROM d GROUP BY ALL UNION ALL SELECT 'ancestor', inner_name, outer_name, count(*) FROM d GROUP BY ALL
UNION ALL SELECT 'following-sibling', a.name, b.name, count(*) FROM n AS a JOIN n AS b ON a.key = b.key AND a.up = b.up AND b.id > a.id GROUP BY a.name, b.name
UNION ALL SELECT 'following', outer_name, inner_name, n FROM f""")
def xml_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of nodes stand on each axis, by their names, in the XML of orders."""
    return trees.axis_counts(_order_documents(spark, sf_dir), "xml")


@query("A1 A15 X42", f"""WITH {_NODES_SQL}
SELECT 'element' AS kind, name, count(*) AS n FROM n GROUP BY name UNION ALL SELECT 'depth', CAST(depth AS VARCHAR), count(*) FROM n GROUP BY depth
UNION ALL SELECT 'namespace', CASE ns WHEN '' THEN '(sem namespace)' ELSE ns END, count(*) FROM n GROUP BY ns
UNION ALL SELECT 'attribute', name || '@' || a, count(*) FROM (SELECT name, unnest(attrs) AS a FROM n) GROUP BY name, a
UNION ALL SELECT 'relation', a.name || ' > ' || b.name, count(*) FROM n AS a JOIN n AS b ON a.key = b.key AND b.up = a.id GROUP BY a.name, b.name""")
def xml_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements, attributes, relations, depths and namespaces of the XML of orders."""
    return trees.structure_counts(_order_documents(spark, sf_dir), "xml")


#: The grammar of the stand-in entries.
ENTRIES = """
entry = @xml:id{DLP-.+} @volp?{only|yes} form+ gramGrp? sense* meta
form = orth
sense = @n?{[0-9]+} def+ sense:inner*
inner as sense = def
meta = @status
orth = text
gramGrp = text
def = text
"""


def _entry_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, xml): an entry for each order, some with mistakes, written in members of .gz and read again."""
    k = F.col("o_orderkey")
    some = lambda n, text, other="": F.when(k % n == 0, text).otherwise(other)
    parts = [
        F.lit('<entry key="'), k.cast("string"), F.lit('"'), some(17, "", ' xml:id="DLP-x"'), some(3, ' volp="only"'), F.lit(">"),
        some(11, "", "<form><orth>o</orth></form>"), F.lit("<gramGrp>s.f.</gramGrp>"), some(13, "<gramGrp>s.m.</gramGrp>"), some(7, '<meta status="ok"/>'),
        F.lit("<sense"), some(23, ' n="b"', ' n="1"'), F.lit(">"), some(19, "", "<def>d</def>"), some(29, "<sense><def>e</def><def>f</def></sense>"), F.lit("</sense>"),
        F.when((k % 7 != 0) & (k % 5 != 0), '<meta status="ok"/>').otherwise(""), some(31, "loose"), F.lit("</entry>"),
    ]
    path = f"{shared_dir(spark)}/florilege/entries-{uuid.uuid4().hex}"
    xmlfiles.write(table(spark, sf_dir, "orders").select(F.concat(*parts)), path, ".gz", "<dic>", "</dic>")
    return xmlparts.read(spark, path, "entry").select(F.xpath_long("xml", F.lit("/entry/@key")).alias("key"), F.regexp_replace("xml", ' key="[0-9]+"', "").alias("xml"))


_MISTAKES = {
    17: "Element entry is missing attribute xml:id", 11: "Expecting an element form, got gramGrp", 13: "Did not expect element gramGrp there", 7: "Did not expect element sense there",
    23: "Element sense has a wrong value of attribute n", 31: "Did not expect text in element entry content",
}
_FAULTS_SQL = " UNION ALL ".join([f"SELECT o_orderkey AS k, '{text}' AS e FROM orders WHERE o_orderkey % {n} = 0" for n, text in _MISTAKES.items()] + [
    "SELECT o_orderkey, 'Expecting an element def, got nothing' FROM orders WHERE o_orderkey % 19 = 0 AND o_orderkey % 29 <> 0",
    "SELECT o_orderkey, 'Expecting an element def, got sense' FROM orders WHERE o_orderkey % 19 = 0 AND o_orderkey % 29 = 0",
    "SELECT o_orderkey, 'Did not expect element def there' FROM orders WHERE o_orderkey % 29 = 0",
    "SELECT o_orderkey, 'Expecting an element meta, got nothing' FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 7 <> 0",
])


@query("Q37 A5 A6 X17", f"""WITH f AS ({_FAULTS_SQL}), o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'VOLP' ELSE 'DLP' END AS kind FROM orders)
SELECT kind, 'valid' AS message, count(*) AS n FROM o WHERE k NOT IN (SELECT k FROM f) GROUP BY kind UNION ALL SELECT kind, 'invalid', count(*) FROM o WHERE k IN (SELECT k FROM f) GROUP BY kind UNION ALL SELECT kind, e, count(*) FROM f JOIN o USING (k) GROUP BY kind, e""")
def grammar_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid and invalid entries by kind under a grammar, and how often each mistake is made."""
    checked = stored(grammar.validated(_entry_documents(spark, sf_dir), "key", "xml", ENTRIES, "entry"), "validated")
    kind = F.when(F.try_element_at("root", F.lit("volp")) == "only", "VOLP").otherwise("DLP").alias("kind")
    message = F.explode(F.concat(F.array(F.when(F.col("valid"), "valid").otherwise("invalid")), F.transform("errors", text.masked_error))).alias("message")
    return checked.select(kind, message).groupBy("kind", "message").agg(F.count("*").alias("n"))


@query("X38 X39 J10", """WITH i AS (SELECT l_orderkey, string_agg('{"n":' || l_linenumber || ',"q":{"amount":"+' || l_partkey || '","lowerBound":null,"upperBound":null}}', ',' ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY 1)
SELECT o_orderkey AS k, sha256('{"items":[' || coalesce(items, '') || '],"p":"P' || o_orderkey % 9 || '","value":{"amount":"+' || o_orderkey || '","lowerBound":null,"text":"é \\" ' || o_orderstatus || '","unit":1,"upperBound":null}}') AS digest, CAST(2 AS BIGINT) AS forms FROM orders LEFT JOIN i ON o_orderkey = l_orderkey""")
def nested_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with nested qualifiers, each in two forms that differ in the order of keys, in white space and in bounds: (k, digest,
    forms with that digest)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    joined = lambda form: F.coalesce(F.array_join(F.transform("lines", form), " , "), F.lit(""))
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    first = joined(lambda x: said('{"q":{"upperBound":"+9","amount":"+', x["l_partkey"], '","lowerBound":"+1"},"n":', x["l_linenumber"], "}"))
    second = joined(lambda x: said('{"n":', x["l_linenumber"], '.0, "q":{"lowerBound":null,"amount":"+', x["l_partkey"], '","upperBound":{"a":1}}}'))
    one = said('{"value":{"unit":1,"upperBound":null,"amount":"+', k, '","text":"\\u00e9 \\" ', status, '","lowerBound":"+1"},"p":"P', k % 9, '","items":[', first, "]}")
    two = said('{ "p" : "P', k % 9, '","items":[', second, '],"value":{"text":"é \\" ', status, '","amount":"+', k, '","lowerBound":[1],"unit":1.0,"upperBound":2}}')
    forms = orders.select(k.alias("k"), F.explode(F.array(one, two)).alias("claim"))
    return forms.select("k", hashing.canonical_digest(F.col("claim")).alias("digest")).groupBy("k", "digest").agg(F.count("*").alias("forms"))
