"""Streams, as an extension: records deduplicated by id, and an idempotent journal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_records(stream: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The first record of each key within the watermark; state older than the delay is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, time: str, width: str, *keys: str, delay: str = "1 hour") -> DataFrame:
    """Rows per window and keys; late rows count until the watermark has passed."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("window"), *keys).agg(F.count("*").alias("n"))


def journal(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: append the actions of a batch whose keys aren't journaled yet; a batch that runs again adds nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        target = f"{path}/batch={batch_id}"
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        known = None
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            known = spark.read.parquet(path).where(F.col("batch") != batch_id).select(key)
        fresh = batch.dropDuplicates([key])
        (fresh.join(known, key, "left_anti") if known is not None else fresh).write.mode("overwrite").parquet(target)

    return write
