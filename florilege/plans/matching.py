"""Missing references, coverage, reconciliation and upsert plans."""

from __future__ import annotations

import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.operators import dedup, profile, reconcile
from florilege.operators.stored import shared_dir
from florilege.registry import query, table
from florilege.streaming import merge


@query("J7 Q35 Q39", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def dangling_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("J6 U2 A22 Q11", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def coverage_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("J4 F6 Q5", "SELECT n_nationkey, n_regionkey - 1 AS parent FROM nation WHERE n_regionkey - 1 <> 0 AND n_regionkey - 1 NOT IN (SELECT r_regionkey FROM region)")
def missing_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") - 1).alias("parent")).where("parent <> 0")
    return terms.join(table(spark, sf_dir, "region"), F.col("parent") == F.col("r_regionkey"), "left_anti")


#: The stand-in live side: customers but for every 11th, balances of every 5th still empty, every 97th twice.
_LIVE_SQL = """live AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment, c_custkey % 3 AS revision FROM customer WHERE c_custkey % 11 <> 0
UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment, 0 FROM customer WHERE c_custkey % 97 = 0 AND c_custkey % 11 <> 0)"""


def _live(customer: DataFrame) -> DataFrame:
    kept = customer.where("c_custkey % 11 <> 0")
    columns = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment", "revision"]
    main = kept.withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))).withColumn("revision", F.col("c_custkey") % 3)
    return main.select(*columns).unionByName(kept.where("c_custkey % 97 = 0").withColumn("revision", F.lit(0).cast("long")).select(*columns))


@query("M1 J9 M3", f"""WITH {_LIVE_SQL}, s AS (SELECT c_custkey, count(*) AS n, max(c_acctbal) AS b FROM live GROUP BY 1)
SELECT c_custkey, CASE WHEN n IS NULL THEN 'created' WHEN n > 1 THEN 'ambiguous' WHEN b IS NULL AND c_acctbal IS NOT NULL THEN 'augmented' ELSE 'unchanged' END AS action FROM customer LEFT JOIN s USING (c_custkey)""")
def upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "customer")
    return reconcile.upsert_plan(plan, _live(plan), "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"])


@query("M1 M5", f"""WITH {_LIVE_SQL}, one AS (SELECT c_custkey, max(c_acctbal) AS b FROM live GROUP BY 1) SELECT c.c_custkey, coalesce(b, c_acctbal) AS c_acctbal FROM customer c LEFT JOIN one USING (c_custkey)""")
def applied_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "customer")
    return reconcile.apply_plan(plan, _live(plan).groupBy("c_custkey").agg(F.max("c_acctbal").alias("c_acctbal")), "c_custkey", ["c_acctbal"])


@query("J10 U6 Q39", f"""WITH {_LIVE_SQL} SELECT c_custkey, c_mktsegment, c_acctbal FROM customer EXCEPT ALL SELECT c_custkey, c_mktsegment, c_acctbal FROM live""")
def missing_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "customer")
    return reconcile.missing_claims(plan, _live(plan), ["c_custkey", "c_mktsegment", "c_acctbal"])


@query("J9 Q39", f"WITH {_LIVE_SQL}, s AS (SELECT c_custkey, count(*) AS n FROM live GROUP BY 1) SELECT CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'matched' END AS state, count(*) AS n FROM customer LEFT JOIN s USING (c_custkey) GROUP BY 1")
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "customer")
    return reconcile.classified(plan, _live(plan), "c_custkey")


@query("J16", f"""WITH {_LIVE_SQL} SELECT c.c_custkey, 'c_acctbal' AS field FROM customer c JOIN live l USING (c_custkey) WHERE c.c_acctbal IS DISTINCT FROM l.c_acctbal""")
def field_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "customer")
    return reconcile.field_differences(plan, _live(plan), "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"])


@query("M4", f"WITH {_LIVE_SQL} SELECT c.c_custkey, CAST(1 AS BIGINT) AS revision, CAST(l.revision AS BIGINT) AS live_revision FROM customer c JOIN live l USING (c_custkey) WHERE l.revision > 1")
def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return reconcile.stale(customer.select("c_custkey", F.lit(1).cast("long").alias("revision")), _live(customer), "c_custkey")


@query("J18 A17", f"WITH {_LIVE_SQL}, e AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), u AS (SELECT c_mktsegment, count(*) AS n FROM live GROUP BY 1) SELECT c_mktsegment, coalesce(e.n, 0) AS expected, coalesce(u.n, 0) AS current FROM e FULL JOIN u USING (c_mktsegment) WHERE coalesce(e.n, 0) <> coalesce(u.n, 0)")
def count_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "customer")
    return reconcile.count_differences(profile.frequencies(plan, "c_mktsegment"), profile.frequencies(_live(plan), "c_mktsegment"), "c_mktsegment")


@query("J12", "SELECT n_nationkey AS subject, '@' || (n_regionkey * 2) AS value, r.r_name AS target FROM nation LEFT JOIN region r ON r.r_regionkey = n_regionkey * 2")
def forward_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("subject"), F.concat(F.lit("@"), (F.col("n_regionkey") * 2).cast("string")).alias("value"))
    ids = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("id"))
    return reconcile.resolved_references(claims, ids).select("subject", "value", "target")


@query("J13", "SELECT (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS only_left, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS only_right")
def both_way_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.complete_both_ways(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("J20", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 50)")
def unlinked_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 50").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(linked, "s_suppkey", "left_anti")


@query("M3 A12", "SELECT l_orderkey, count(*) AS n, count(*) - 1 AS extra FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.repeated(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber").select("l_orderkey", "n", "extra")


@query("X39 J10", "SELECT c_custkey, 'P1|quantity|' || c_custkey || '|' || CASE WHEN c_mktsegment < 'x' THEN c_mktsegment || ';x' ELSE 'x;' || c_mktsegment END AS signature FROM customer")
def claim_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from florilege.functions.hashing import claim_signature

    value = F.concat(F.col("c_custkey").cast("string"), F.lit(" [0, 1]"))
    return table(spark, sf_dir, "customer").select("c_custkey", claim_signature(F.lit("P1"), F.lit("quantity"), value, F.array(F.lit("x"), F.col("c_mktsegment"))).alias("signature"))


_DATATYPE = "CASE n_nationkey % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'time' ELSE 'quantity' END"


@query("J11", f"SELECT n_nationkey AS key, CASE WHEN n_nationkey % 7 <> 0 THEN 'P' || n_nationkey END AS id, CASE WHEN n_nationkey % 7 = 0 THEN 'missing' WHEN n_nationkey % 5 = 0 AND {_DATATYPE} <> 'string' THEN 'datatype' END AS problem FROM nation")
def property_datatypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned properties, one per nation, against live ones, of which some are missing and some have another datatype."""
    nation = table(spark, sf_dir, "nation")
    datatype = F.expr(_DATATYPE)
    plan = nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("label"), datatype.alias("datatype"))
    live = nation.where("n_nationkey % 7 <> 0").select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 5 == 0, "string").otherwise(datatype).alias("datatype"))
    return reconcile.property_ids(plan, live)


@query("Q39 J10", "SELECT o_custkey AS subject, o_orderkey AS signature, o_clerk AS source FROM (SELECT o_custkey, o_orderkey, o_orderpriority AS o_clerk FROM orders WHERE o_orderkey % 4 <> 0) WHERE o_orderkey % 3 = 0 AND o_clerk <> '1-URGENT'")
def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims of customers, their priority as source; each third live one names another source."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("signature"), F.col("o_orderpriority").alias("source"))
    live = orders.where("signature % 4 <> 0").select("subject", "signature", F.when(F.col("signature") % 3 == 0, F.array(F.lit("1-URGENT"))).otherwise(F.array(F.lit("x"), "source")).alias("sources"))
    return reconcile.missing_sources(orders, live)


@query("J17", "SELECT conv_id AS parent, turn AS position, CASE WHEN turn % 7 = 6 THEN 'missing' WHEN turn % 5 = 4 THEN 'hash' END AS problem FROM conversations WHERE turn % 7 = 6 OR turn % 5 = 4 UNION ALL SELECT conv_id, 1000, 'unknown' FROM conversations WHERE turn = 0")
def image_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as images of a conversation; the stored side lacks some, has others instead of some, and one too many."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("parent"), F.col("turn").alias("position"), F.sha2(F.concat_ws("|", "conv_id", "turn", "text"), 256).alias("hash"))
    kept = turns.where("position % 7 <> 6").withColumn("hash", F.when(F.col("position") % 5 == 4, F.lit("other")).otherwise(F.col("hash")))
    extra = turns.where("position = 0").withColumn("position", F.lit(1000).cast(turns.schema["position"].dataType))
    return reconcile.image_differences(turns, kept.unionByName(extra))


@query("P4", "SELECT p_partkey, 'P1' AS property, p_name AS value FROM part WHERE trim(p_name) <> '' UNION ALL SELECT p_partkey, 'P7', p_type FROM part WHERE trim(p_type) <> '' UNION ALL SELECT p_partkey, 'P9', CAST(p_size AS VARCHAR) FROM part WHERE p_size > 25")
def properties_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of cells whose place says which property they hold; the second column has none, small sizes are blank."""
    size = F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise(F.lit(" "))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array("p_name", "p_brand", "p_type", size).alias("cells"))
    return reconcile.by_position(rows, "p_partkey", "cells", ("P1", None, "P7", "P9"))


_MERGE_SQL = """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 3 THEN o_orderstatus ELSE 'manual' END AS status,
CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN NULL WHEN 2 THEN 'kept' ELSE o_orderpriority END AS priority,
CAST(CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 7 WHEN 2 THEN 1 ELSE 1 END AS BIGINT) AS revision,
['augmented', 'stale', 'unchanged', 'created'][1 + o_orderkey % 4] AS action, CAST(CASE WHEN o_orderkey % 4 IN (0, 3) THEN 1 ELSE 0 END AS BIGINT) AS writes FROM orders"""


@query("M1 M4 M5", _MERGE_SQL)
def merged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders merged from a stream into a store that has three of four already, one of them at a later revision. The first run
    breaks off between two parts of a batch; the second goes on, and recovers what the store had taken."""
    folder = f"{shared_dir(spark)}/florilege/merge-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    kind = F.col("k") % 4
    planned = orders.withColumn("base", F.when(kind != 3, 1).cast("long"))
    # a file a batch, in row groups that several tasks can read
    planned.repartition(4, "k").write.option("parquet.block.size", 8 << 20).parquet(f"{folder}/plan")
    fields = {f.name: f for f in planned.schema.fields}
    store = merge.Store(spark, f"{folder}/store", fields["k"], [fields["status"], fields["priority"]])
    live = orders.where(kind != 3).select("k", F.lit("manual").alias("status"), F.when(kind == 2, "kept").alias("priority"), F.when(kind == 1, 7).otherwise(1).cast("long").alias("revision"), F.lit("before").alias("request"))
    store.append(live)
    stream = spark.readStream.schema(planned.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/plan")

    def broken(batch_id: int, part: int) -> None:
        if batch_id == 1 and part == 1:
            raise ConnectionError("the service went away")

    try:
        merge.run(stream, merge.merger(store, before_part=broken), f"{folder}/checkpoint")
    except StreamingQueryException:
        pass  # what a restart has to cope with
    merge.run(stream, merge.merger(store), f"{folder}/checkpoint")
    newest = F.max(F.struct("revision", "status", "priority")).alias("x")
    states = store.log().groupBy("k").agg(newest, F.count_if(F.col("request") != "before").alias("writes"))
    done = merge.journaled(store).select("k", "action")
    return states.join(done, "k").select("k", "x.status", "x.priority", "x.revision", "action", "writes")
