"""Catalogue requests: facets, pages, searches, selections."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.operators import catalog, indexes, profile
from florilege.operators.stored import shared_dir, stored
from florilege.registry import query, table


@query("A16 J14", "SELECT p_brand, count(DISTINCT o_orderkey) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY p_brand")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    relations = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return catalog.facets(relations, "o_orderkey", "p_brand")


@query("F19 O7 O9", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 24 OFFSET 48")
def catalogue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    return catalog.page(items, [F.desc("o_totalprice"), "o_orderkey"], 3, 24)


@query("F19 O7 O9 J15", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 10 <> 0 AND o_orderpriority = '1-URGENT' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') ORDER BY o_totalprice DESC, o_orderkey LIMIT 12 OFFSET 12")
def published_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of published orders without a password, of one collection and with a term; the size asked for isn't offered."""
    orders = table(spark, sf_dir, "orders")
    items = orders.select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") == "P", "draft").otherwise("publish").alias("status"), F.when(F.col("o_orderkey") % 10 == 0, "x").alias("password"), F.col("o_orderpriority").alias("collection"))
    relations = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("term"))
    found = catalog.published(items, "o_orderkey", "1-URGENT", relations, ("R",))
    return catalog.page(found, [F.desc("o_totalprice"), "o_orderkey"], 2, 13).select("o_orderkey")


@query("F20 J15 X23", """SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE (contains(lower(c_name), 'machinery') OR contains(lower(c_mktsegment), 'machinery') OR contains(lower(n_name), 'machinery'))
AND (contains(lower(c_name), 'nation_1') OR contains(lower(c_mktsegment), 'nation_1') OR contains(lower(n_name), 'nation_1'))""")
def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    terms = customer.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return catalog.matching(customer, "c_custkey", "MACHINERY nation_1", ["c_name", "c_mktsegment"], [(terms, "n_name")]).select("c_custkey")


@query("F21", "SELECT doc_id FROM documents WHERE contains(lower(text), 'pathetic')")
def directory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.matching(table(spark, sf_dir, "documents"), "doc_id", "pathetic", ["text"]).select("doc_id")


SEARCHES = ("eau*** que", "%%% QUE&AMP; r%%%", "und_r", "te", "<p> zz_%", "Der nicht")
_SEARCH_SQL = " UNION ALL ".join(f"""SELECT '{s}' AS request, page_id AS id FROM pages WHERE {' AND '.join(f"contains(lower(html), '{w.lower()}')" for w in s.split())}""" for s in SEARCHES)


@query("F20 F21 X23", _SEARCH_SQL)
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that hold all words of each request, signs of patterns among them, by an index of their HTML."""
    folder = f"{shared_dir(spark)}/florilege/index-{uuid.uuid4().hex}"
    indexes.index_texts(table(spark, sf_dir, "pages"), "page_id", "html", folder)
    found = [indexes.search(spark, folder, request).select(F.lit(request).alias("request"), "id") for request in SEARCHES]
    return reduce(DataFrame.unionByName, found)


_RELATIONS_SQL = "r AS (SELECT o_orderkey AS k, 'status' AS taxonomy, o_orderstatus AS term FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders UNION ALL SELECT l_orderkey, 'flag', l_returnflag FROM lineitem UNION ALL SELECT l_orderkey, 'brand', p_brand FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT o_orderkey, 'password', CASE WHEN o_orderkey % 10 = 0 THEN 'yes' ELSE 'no' END FROM orders)"


@query("A16 J14 F19", f"""WITH {_RELATIONS_SQL}, a AS (SELECT k FROM r WHERE taxonomy = 'status' AND term IN ('F', 'P') INTERSECT SELECT k FROM r WHERE taxonomy = 'password' AND term = 'no'), b AS (SELECT k FROM a INTERSECT SELECT k FROM r WHERE taxonomy = 'flag' AND term = 'R')
SELECT 'none' AS filters, taxonomy, term, count(DISTINCT k) AS n FROM r GROUP BY ALL UNION ALL SELECT 'two', taxonomy, term, count(DISTINCT k) FROM r WHERE k IN (FROM a) GROUP BY ALL UNION ALL SELECT 'three', taxonomy, term, count(DISTINCT k) FROM r WHERE k IN (FROM b) GROUP BY ALL""")
def filtered_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different orders per term of several taxonomies, under no, two and three filters, from stored bitmaps."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    of = lambda df, key, taxonomy, term: df.select(F.col(key).alias("k"), F.lit(taxonomy).alias("taxonomy"), term.alias("term"))
    brands = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    relations = [
        of(orders, "o_orderkey", "status", F.col("o_orderstatus")), of(orders, "o_orderkey", "priority", F.col("o_orderpriority")), of(lines, "l_orderkey", "flag", F.col("l_returnflag")),
        of(brands, "l_orderkey", "brand", F.col("p_brand")), of(orders, "o_orderkey", "password", F.when(F.col("o_orderkey") % 10 == 0, "yes").otherwise("no")),
    ]
    index = stored(indexes.term_bitmaps(reduce(DataFrame.unionByName, relations), "k"), "bitmaps")
    two = {"status": ("F", "P"), "password": ("no",)}
    asked = {"none": {}, "two": two, "three": two | {"flag": ("R",)}}
    return reduce(DataFrame.unionByName, [indexes.facets_under(index, f).select(F.lit(name).alias("filters"), "taxonomy", "term", "n") for name, f in asked.items()])


@query("F22 U5 F17", "SELECT p_partkey FROM part WHERE p_type = 'PROMO' AND p_size = 11 AND contains(p_name, 'ring')")
def topic_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    level = parts.where("p_size = 11").select("p_size").distinct()  # a level that no item has filters nothing out elsewhere
    return parts.where("p_type = 'PROMO' AND contains(p_name, 'ring')").join(level, "p_size", "left_semi").select("p_partkey")


@query("F23 P7", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'selected' WHEN o_totalprice > 400000 THEN 'editorial' WHEN o_orderstatus = 'P' THEN 'external' ELSE 'none' END AS decision, 'orders' AS collection FROM orders")
def selection_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.col("o_orderpriority") == "1-URGENT", "selected").when(F.col("o_totalprice") > 400000, "editorial").when(F.col("o_orderstatus") == "P", "external").otherwise("none")
    return table(spark, sf_dir, "orders").select("o_orderkey", decision.alias("decision"), F.lit("orders").alias("collection"))


@query("A17 O10", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0 GROUP BY n_name ORDER BY n DESC, n_name LIMIT 6")
def largest_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "supplier").where("s_acctbal > 0").groupBy("s_nationkey").agg(F.count("*").alias("k"))
    named = held.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name").agg(F.sum("k").alias("n")).orderBy(F.desc("n"), "n_name").limit(6)


@query("W5 A21", "SELECT conv_id, turn, CAST(turn + 1 AS BIGINT) AS ordinal, CASE WHEN turn = 0 THEN 'primary' WHEN turn = 1 THEN 'verso' ELSE 'detail' END AS place_role FROM conversations")
def ordinals_and_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = profile.numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"])
    return numbered.select("conv_id", "turn", "ordinal", F.when(F.col("ordinal") == 1, "primary").when(F.col("ordinal") == 2, "verso").otherwise("detail").alias("place_role"))


#: What a request for the newest published posts with a term and a value asks of the store's five tables.
_CMS_SQL = """SELECT p.id, p.title, t.name AS term FROM {0}posts AS p JOIN {0}term_relationships AS r ON r.object_id = p.id JOIN {0}term_taxonomy AS x ON x.term_taxonomy_id = r.term_taxonomy_id JOIN {0}terms AS t ON t.term_id = x.term_id
WHERE p.status = 'publish' AND x.taxonomy = 'flag' AND EXISTS (SELECT 1 FROM {0}postmeta AS m WHERE m.post_id = p.id AND m.meta_key = 'priority' AND m.meta_value LIKE '1%') ORDER BY p.date DESC, p.id, t.name LIMIT 50"""
_CMS_TABLES = {
    "posts": "SELECT o_orderkey AS id, concat('Order ', CAST(o_orderkey AS STRING)) AS title, CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE 'publish' END AS status, o_orderdate AS date FROM orders",
    "postmeta": "SELECT o_orderkey AS post_id, 'priority' AS meta_key, o_orderpriority AS meta_value FROM orders UNION ALL SELECT o_orderkey, 'total', CAST(CAST(o_totalprice AS BIGINT) AS STRING) FROM orders",
    "terms": "SELECT DISTINCT ascii(l_returnflag) AS term_id, l_returnflag AS name FROM lineitem",
    "term_taxonomy": "SELECT DISTINCT ascii(l_returnflag) + 1000 AS term_taxonomy_id, ascii(l_returnflag) AS term_id, 'flag' AS taxonomy FROM lineitem",
    "term_relationships": "SELECT DISTINCT l_orderkey AS object_id, ascii(l_returnflag) + 1000 AS term_taxonomy_id FROM lineitem",
}


@query("S17 J14 J15 O8", "WITH " + ", ".join(f"cms_{name} AS ({sql.replace('STRING', 'VARCHAR')})" for name, sql in _CMS_TABLES.items()) + " (" + _CMS_SQL.format("cms_") + ")")
def cms_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest published posts with their terms, by SQL over the five tables of a store, which are views of a session."""
    views = {name: table(spark, sf_dir, name) for name in ("orders", "lineitem")}
    prefix = f"cms_{uuid.uuid4().hex}_"
    for name, sql in _CMS_TABLES.items():
        spark.sql(sql.replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}"), **{k: v for k, v in views.items() if f"FROM {k}" in sql}).createOrReplaceTempView(prefix + name)
    found = spark.sql(_CMS_SQL.format(prefix))
    for name in _CMS_TABLES:
        spark.catalog.dropTempView(prefix + name)
    return found
