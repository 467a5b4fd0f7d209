"""The store's log by shares: what a batch shuffles, keys of another type, entities without a key."""

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from florilege.streaming import merge

KEY = StructField("k", LongType())
COLUMNS = [StructField("name", StringType()), StructField("note", StringType())]
PLAN = "k long, name string, note string, base long"


def shuffled(spark):
    """Records that the session's stages have written for shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_batches_shuffle_their_shares_alone(spark, tmp_path):
    n, batches = 4000, 4
    store = merge.Store(spark, str(tmp_path / "s"), KEY, COLUMNS)
    live = spark.range(n).select(F.col("id").alias("k"), F.lit("live").alias("name"), F.lit(None).cast("string").alias("note"), F.lit(1).cast("long").alias("revision"), F.lit("before").alias("request"))
    store.append(live)
    plan = spark.range(n).select(F.col("id").alias("k"), F.lit("n").alias("name"), F.lit("plan").alias("note"), F.lit(1).cast("long").alias("base"))
    plan.repartition(batches, "k").write.parquet(str(tmp_path / "plan"))
    stream = spark.readStream.schema(plan.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "plan"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        before = shuffled(spark)
        merge.run(stream, merge.merger(store), str(tmp_path / "cp"))
        # each request and each live row once, and at most the shares of each task; the whole log for each batch would be 4 * n and more
        assert shuffled(spark) - before <= 2 * n + 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert merge.journaled(store).where("action = 'augmented' AND revision = 2 AND NOT recovered").count() == n
    assert store.current().where("name = 'live' AND note = 'plan' AND revision = 2").count() == n and store.log().count() == 2 * n


def test_shares_hold_the_whole_log(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path / "s"), KEY, COLUMNS)
    store.append(spark.range(100).selectExpr("id AS k", "'a' AS name", "'b' AS note", "1L AS revision", "'x' AS request"))
    assert store.log(range(merge.SHARES)).count() == store.log().count() == 100
    assert store.log([3]).exceptAll(store.log().where(store.share() == 3)).count() == 0 and 0 < store.log([3]).count() < 100
    assert store.log([]).count() == 0


def test_keys_of_another_type_and_none(spark, tmp_path):
    store = merge.Store(spark, str(tmp_path / "s"), KEY, COLUMNS)
    rows = [(i, "a", None, None) for i in range(20)] + [(None, "none", None, None)]
    merge.merger(store)(spark.createDataFrame(rows, PLAN), 0)
    assert store.log().count() == 21
    # the same requests again, keys as int: all were taken, that of the entity without a key too
    merge.merger(store)(spark.createDataFrame(rows, PLAN.replace("k long", "k int")), 1)
    again = merge.journaled(store).where("batch = 1")
    assert again.count() == again.where("recovered AND action = 'created' AND revision = 1").count() == 21
    assert store.log().count() == 21
    # others for the same entities: an update of the revision that stands, and a second creation
    more = [(i, "b", "note", 1) for i in range(0, 20, 2)] + [(None, "other", None, None)]
    merge.merger(store)(spark.createDataFrame(more, PLAN.replace("k long", "k int")), 2)
    done = {r["k"]: (r["action"], r["revision"]) for r in merge.journaled(store).where("batch = 2").collect()}
    assert done == {i: ("augmented", 2) for i in range(0, 20, 2)} | {None: ("stale", 1)}
