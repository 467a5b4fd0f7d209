"""A checkpointed merge of a stream of planned entities into a store of revisions.

The store is a log: each change is an entity with the revision that it makes and the request that asked for it; an entity's state
is that of its highest revision. The log is dealt by entity into shares, so a batch reads those that its entities fall into.
Requests are merged in batches, in parts that are written one after another, and what was done is journaled at a batch's end. A
batch that is run again, as its journal was never written, finds among the requests of its entities which changes the store has
taken though no answer was kept, and writes the others alone, so nothing is written twice. An update names the revision it was
planned for, and is refused where the store has another by then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from florilege.operators.stored import stored

ACTIONS = ("created", "augmented", "unchanged", "stale")

#: Shares of a store's log, and the folders' column that says which. A store keeps the number that it was written with.
SHARES, SHARE = 16, "_share"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has a file or folder there."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    return given.getFileSystem(spark._jsc.hadoopConfiguration()).exists(given)


class Store:
    """A log of changes below a folder: key, columns, revision, request."""

    def __init__(self, spark: SparkSession, folder: str, key: StructField, columns: list[StructField]):
        self.spark, self.folder, self.key = spark, folder, key.name
        self.columns = [c.name for c in columns]
        self.schema = StructType([key, *columns, StructField("revision", LongType()), StructField("request", StringType())])

    def share(self) -> Column:
        """The share that an entity falls into; hashes depend on the type."""
        return F.pmod(F.hash(F.col(self.key).cast(self.schema[self.key].dataType)), F.lit(SHARES))

    def log(self, shares: Iterable[int] | None = None) -> DataFrame:
        """All changes, or those of some shares."""
        path = f"{self.folder}/changes"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], self.schema)
        log = self.spark.read.schema(StructType([*self.schema.fields, StructField(SHARE, IntegerType())])).parquet(path)
        return (log if shares is None else log.where(F.col(SHARE).isin(list(shares)))).drop(SHARE)

    def append(self, changes: DataFrame) -> None:
        """One job, so its rows appear together or not at all."""
        changes.select(*self.schema.names, self.share().alias(SHARE)).write.mode("append").partitionBy(SHARE).parquet(f"{self.folder}/changes")

    def current(self) -> DataFrame:
        """The state of each entity. Rows are reduced before they are shuffled."""
        rest = [c for c in self.schema.names if c not in (self.key, "revision")]
        newest = F.max(F.struct("revision", *rest)).alias("x")
        return self.log().groupBy(self.key).agg(newest).select(self.key, "x.*").select(*self.schema.names)


def request_of(key: str, columns: list[str]) -> Column:
    """What tells a request from others: its entity, the revision it was planned for, and what it asks for."""
    return F.sha2(F.to_json(F.struct(key, "base", *columns), {"ignoreNullFields": "false"}), 256)


def seen(asked: DataFrame, log: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """asked (_entity: the key in a struct, so that null finds null; base, request, columns) with the key, the live revision and
    values of each entity (_revision, _columns), and the revision by which the store has taken the request already (_taken). The log
    is shuffled once, by entity, for both."""
    states = log.select(F.struct(key).alias("_entity"), F.struct("revision", *columns).alias("_state"), F.col("request").alias("_request"))
    taken = F.min(F.when(F.col("_request") == F.col("request"), F.col("_state.revision"))).alias("_taken")
    request = F.first(F.struct("base", "request", *columns)).alias("_asked")  # an entity has one
    out = asked.join(states, "_entity", "left").groupBy("_entity").agg(request, F.max("_state").alias("_live"), taken)
    return out.select(F.col("_entity")[key].alias(key), "_asked.*", "_taken", F.col("_live.revision").alias("_revision"), *[F.col("_live")[c].alias(f"_{c}") for c in columns])


def decided(found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """What seen() gives, with an action, the revision that stands afterwards, and the state that the change makes; for requests
    that the store has taken, whatever came of them since, what was done then. Live values are never cleared or overwritten; base
    is null for what should be created."""
    gain = F.lit(False)
    for c in columns:
        gain = gain | (F.col(f"_{c}").isNull() & F.col(c).isNotNull())
    known, recovered, new = F.col("_revision").isNotNull(), F.col("_taken").isNotNull(), F.col("base").isNull()
    done = F.when(new, "created").otherwise("augmented")
    action = F.when(recovered, done).when(~known & new, "created").when(~F.col("base").eqNullSafe(F.col("_revision")), "stale").when(gain, "augmented").otherwise("unchanged")
    out = found.withColumn("action", action).withColumn("recovered", recovered)
    changed = F.col("action").isin("created", "augmented") & ~F.col("recovered")
    after = F.when(changed, F.coalesce("_revision", F.lit(0)) + 1).otherwise(F.coalesce("_taken", "_revision"))
    # requests are needed with changes alone
    return out.select(key, F.when(changed, F.col("request")).alias("request"), "action", after.cast("long").alias("revision"), "recovered", changed.alias("changed"), *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def merger(store: Store, parts: int = 2, before_part: Callable[[int, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over (key, columns, base): merges a batch in `parts` parts and journals it below the store's folder as
    (key, action, revision, recovered, batch). before_part (batch, part) is called before a part is written.

    Of several requests for one entity in a batch, that with the smallest request counts; the others come in no journal, as a
    batch knows one state of an entity.
    """
    key, columns, spark = store.key, store.columns, store.spark
    journal = f"{store.folder}/journal"

    def write(batch: DataFrame, batch_id: int) -> None:
        if exists(spark, f"{journal}/batch={batch_id}/_SUCCESS"):
            return
        # requests as bytes have the order of their digits, in half the space
        first = F.min(F.struct(F.unhex(request_of(key, columns)).alias("request"), "base", *columns)).alias("x")
        asked = batch.groupBy(F.struct(key).alias("_entity")).agg(first).select("_entity", "x.*").withColumn("request", F.lower(F.hex("request")))
        shares = [r[0] for r in batch.select(store.share()).distinct().collect()]
        decisions = stored(decided(seen(asked, store.log(shares), key, columns), key, columns), "decisions")
        changes = decisions.where("changed")
        for part in range(parts):
            if before_part:
                before_part(batch_id, part)
            store.append(changes.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part))
        decisions.select(key, "action", "revision", "recovered").write.mode("overwrite").parquet(f"{journal}/batch={batch_id}")

    return write


def journaled(store: Store) -> DataFrame:
    """(key, action, revision, recovered, batch) of all batches that came to their end."""
    schema = f"`{store.key}` {store.schema[store.key].dataType.simpleString()}, action string, revision long, recovered boolean, batch int"
    return store.spark.read.schema(schema).parquet(f"{store.folder}/journal")


def run(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Merge all that the stream has now; called again after a failure, it goes on from the checkpoint."""
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
