"""Frequencies, groups, sequences, dates and summaries over the record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions import dates, hashing, text
from florilege.operators import catalog, profile
from florilege.registry import query, table


@query("W2 A14", "SELECT event_type, n, ordinal, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS ordinal, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE ordinal <= 25")
def first_n_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_type", "event_id")
    return profile.first_n(events, ["event_type"], ["event_id"], 25).join(profile.frequencies(events, "event_type"), "event_type").select("event_type", "n", "ordinal", "event_id")


@query("A5 Q37", "SELECT event_type AS kind, value > 50 AS valid, count(*) AS n, CAST(grouping_id(event_type, value > 50) AS BIGINT) AS level FROM events GROUP BY GROUPING SETS ((), (event_type), (value > 50), (event_type, value > 50))")
def valid_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.by_sets(table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), (F.col("value") > 50).alias("valid")), "kind", "valid")


@query("A2 X44 X43", "SELECT k AS key, json_extract_string(props, '$.' || k) AS value, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY 1, 2")
def attribute_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return profile.frequencies(parsed, "key", "value")


@query("A3", "SELECT coalesce(nullif(lang, ''), '(none)') AS lang, coalesce(nullif(source, ''), '(none)') AS source, count(*) AS n FROM documents GROUP BY 1, 2")
def categorical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.frequencies(table(spark, sf_dir, "documents"), profile.bucket("lang", "(none)").alias("lang"), profile.bucket("source", "(none)").alias("source"))


@query("A4", "SELECT o_orderstatus AS status, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low, count(*) AS n FROM orders GROUP BY 1")
def two_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.count_if(F.col("o_orderpriority") == p)
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(count("1-URGENT").alias("urgent"), count("5-LOW").alias("low"), F.count("*").alias("n"))


@query("A6 X17", "SELECT regexp_replace('Element ''' || p_type || ''' in DLP-' || p_partkey || ' fails', '\\bDLP-[^\\s,;]+', 'DLP-…', 'g') AS message, count(*) AS n FROM part GROUP BY 1")
def error_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("Element '"), "p_type", F.lit("' in DLP-"), F.col("p_partkey").cast("string"), F.lit(" fails"))
    return profile.frequencies(table(spark, sf_dir, "part"), text.masked_error(message).alias("message"))


@query("A7 A13 X2", "SELECT lower(p_name) AS name_key, count(*) AS n, (SELECT string_agg(CAST(x AS VARCHAR), ' | ' ORDER BY x) FROM (SELECT unnest(list_sort(list(p_partkey))[1:5]) AS x)) AS examples FROM part GROUP BY 1 HAVING count(*) > 1")
def normalized_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "part").select(text.norm_text(F.col("p_name")).alias("name_key"), "p_partkey")
    return profile.with_examples(keyed, ["name_key"], ["p_partkey"], 5).where("n > 1")


@query("W3 Q30", "SELECT l_orderkey, count(*) AS breaks FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS p FROM lineitem) WHERE l_linenumber <= p GROUP BY 1")
def sequence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return profile.out_of_sequence(lines, "l_orderkey", "at", "l_linenumber")


@query("W3 A20", "SELECT conv_id, list_sort(t) = t AND len(list_distinct(t)) = len(t) AS in_order, CAST(len(t) AS BIGINT) AS turns, bool_or(u) AS has_user FROM (SELECT conv_id, list(turn ORDER BY turn) AS t, bool_or(role = 'user') AS u FROM conversations GROUP BY conv_id) GROUP BY conv_id, t")
def conversation_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    # distinct turns against their range: no list per conversation is needed
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("turn").alias("d"), F.bool_or(F.col("role") == "user").alias("has_user"))
    return turns.select("conv_id", (F.col("turns") == F.col("d")).alias("in_order"), "turns", "has_user")


_PARTIAL = "CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y') || '/02/31' WHEN o_orderkey % 7 = 1 THEN strftime(o_orderdate, '%Y') || '?' WHEN o_orderkey % 7 = 2 THEN strftime(o_orderdate, '%Y') WHEN o_orderkey % 7 = 3 THEN strftime(o_orderdate, '%Y/%m') ELSE strftime(o_orderdate, '%Y/%m/%d') END"


@query("X35", f"""SELECT o_orderkey, raw, CASE WHEN o_orderkey % 7 > 1 THEN CAST(9 + length(raw) - length(replace(raw, '/', '')) AS INT) END AS precision FROM (SELECT o_orderkey, {_PARTIAL} AS raw FROM orders)""")
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, key = F.date_format("o_orderdate", "yyyy"), F.col("o_orderkey") % 7
    raw = F.when(key == 0, F.concat(year, F.lit("/02/31"))).when(key == 1, F.concat(year, F.lit("?"))).when(key == 2, year).when(key == 3, F.date_format("o_orderdate", "yyyy/MM")).otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return rows.select("o_orderkey", "raw", dates.partial_date(F.col("raw"))["precision"].alias("precision"))


@query("X36 Q21", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS read FROM orders")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    formats = ("yyyy-MM-dd", "dd/MM/yyyy", "d-M-yyyy", "yyyy/M/d")
    raw = F.lit("90/02/2016")
    for k, f in enumerate(formats):
        raw = F.when(F.col("o_orderkey") % 5 == k, F.date_format("o_orderdate", f)).otherwise(raw)
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.parsed_date(raw).alias("read"))


@query("X37", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AT TIME ZONE 'Europe/Lisbon' AT TIME ZONE 'UTC' AS published FROM orders")
def published_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.published_utc(F.col("o_orderdate").cast("timestamp"), "Europe/Lisbon").alias("published"))


@query("P9 A10 A11 A17 A22", """SELECT 'documents' AS indicator, count(*) AS value FROM documents UNION ALL SELECT 'with_text', count(*) FILTER (coalesce(text, '') <> '') FROM documents UNION ALL SELECT 'long', count(*) FILTER (length(text) > 3000) FROM documents
UNION ALL SELECT 'missing', greatest(5000 - count(text), 0) FROM documents""")
def summary_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return profile.summary(docs, documents=F.count("*"), with_text=F.count_if(F.coalesce("text", F.lit("")) != ""), long=F.count_if(F.length("text") > 3000), missing=F.greatest(F.lit(5000) - F.count("text"), F.lit(0)))


@query("A15 A1", "SELECT max(turn) AS deepest, (SELECT min(role) FROM conversations WHERE turn = 0) AS root FROM conversations")
def deepest_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.agg(F.max("turn").alias("deepest"), F.min(F.when(F.col("turn") == 0, F.col("role"))).alias("root"))


@query("A18 Q38 F9", "SELECT count(*) AS rows, count(*) FILTER (coalesce(trim(text), '') <> '') AS filled, count(*) FILTER (coalesce(trim(text), '') = '') AS empty, count(*) FILTER (length(text) > 1500) AS long_cells, count(*) - count(DISTINCT text) AS repeated FROM conversations")
def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = F.coalesce(F.trim("text"), F.lit("")) != ""
    return table(spark, sf_dir, "conversations").agg(F.count("*").alias("rows"), F.count_if(filled).alias("filled"), F.count_if(~filled).alias("empty"), F.count_if(F.length("text") > 1500).alias("long_cells"), (F.count("*") - F.count_distinct("text")).alias("repeated"))


@query("A11 O3", "SELECT event_type, n, first_seen FROM (SELECT event_type, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1)")
def most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen")


@query("A21 X45", "SELECT conv_id, CAST(list_sum(list_transform(list(text), lambda t: length(t))) AS BIGINT) AS chars, CAST(len(list_distinct(list(role))) AS BIGINT) AS roles FROM conversations GROUP BY conv_id")
def section_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).cast("long").alias("chars"), F.count_distinct("role").alias("roles"))


@query("P6", "SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS asked, arg_min(text, turn) FILTER (role = 'assistant') AS answered FROM conversations GROUP BY conv_id")
def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(first("user").alias("asked"), first("assistant").alias("answered"))


@query("O8 S18", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5")
def latest_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(5)


@query("S16 W4 X47", "SELECT CAST((c_custkey // 50) AS BIGINT) AS batch, count(*) AS n, string_agg(CAST(c_custkey AS VARCHAR), '|' ORDER BY c_custkey) AS ids FROM customer GROUP BY 1")
def id_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 50).cast("long").alias("batch"), "c_custkey")
    return keyed.groupBy("batch").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda k: k.cast("string")), "|").alias("ids"))


@query("X39 X38", "SELECT event_id, sha256('k=' || json_extract_string(props, '$.k')) AS digest FROM events")
def property_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", hashing.map_digest(F.from_json("props", "map<string,string>")).alias("digest"))


@query("X40", "SELECT p_partkey, round_even(CAST(p_retailprice AS DECIMAL(12, 3)) / 8, 2)::DOUBLE AS eighth, format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) AS shown FROM part")
def rounded_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("p_retailprice").cast("decimal(12,3)")
    return table(spark, sf_dir, "part").select("p_partkey", F.bround(price / 8, 2).cast("double").alias("eighth"), F.format_number(F.floor("p_retailprice").cast("long"), 0).alias("shown"))


@query("W4 O9", "SELECT o_orderkey, place, (place - 1) // 50 + 1 AS page FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders)")
def paginate_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.paginated(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "place", "page")


@query("W4 K11", "SELECT page, (page - 1) * 50 + 1 AS first, least(page * 50, n) AS last, ((page - 1) * 50 + 1) || '–' || least(page * 50, n) || ' of ' || n AS label FROM (SELECT n, unnest(range(1, (n + 49) // 50 + 1)) AS page FROM (SELECT count(*) AS n FROM orders))")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.page_ranges(table(spark, sf_dir, "orders"))
