"""Duplicates and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.operators.stored import stored


#: Rows of one key up to which a single task numbers them.
HOT_ROWS = 5_000_000


def repeated(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Keys that occur more than once, with their rows (n) and extra rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("extra", F.col("n") - 1)


def fresh(name: str, taken: list[str]) -> str:
    """name, or with underscores added to it, so that no column has it."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def first_seen(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given."""
    seen = fresh("seen", df.columns)
    return df.withColumn(seen, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(seen) == 1).drop(seen)


def counted_off(df: DataFrame, key: str, order: Column, name: str, hot: int = HOT_ROWS) -> DataFrame:
    """df with the place of each row within its key, from 1. Keys of more than `hot` rows are spread over tasks by their order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    if df.groupBy(key).count().where(F.col("count") > hot).isEmpty():
        return df.withColumn(name, place)
    part, before = fresh("part", [*df.columns, name]), fresh("before", [*df.columns, name])
    dealt = stored(df.repartitionByRange(F.col(key), order).withColumn(part, F.spark_partition_id()), "dealt")
    # parts of a key that lies in several ones: as few rows as there are tasks, at most two keys each
    sizes = dealt.groupBy(key, part).count()
    spread = sizes.groupBy(key).agg(F.count("*").alias("parts")).where("parts > 1")
    earlier = Window.partitionBy(key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.join(spread, key).select(F.col(key), F.col(part), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(key, part).orderBy(order))
    placed = dealt.withColumn(name, inside).join(offsets, [key, part], "left")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], (F.col(name) + F.coalesce(before, F.lit(0))).alias(name))


def identities(df: DataFrame, digest: Column, order: Column, preferred: Column | None = None, length: int = 24) -> DataFrame:
    """df with a stable key per row: the preferred one where it is unique, else the row's digest, with :duplicate:n from the
    second on."""
    names = [fresh(n, df.columns) for n in ("digest", "own", "uses", "nth")]
    base, own, uses, nth = names
    out = df.withColumn(base, F.left(digest, F.lit(length)))
    if preferred is not None:
        out = out.withColumn(own, preferred)
        counts = out.where(F.col(own).isNotNull()).groupBy(own).agg(F.count("*").alias(uses))
        out = out.join(counts, own, "left").withColumn(base, F.when(F.col(uses) == 1, F.concat(F.lit("own:"), F.col(own).cast("string"))).otherwise(F.col(base)))
    out = counted_off(out, base, order, nth)
    key = F.when(F.col(nth) == 1, F.col(base)).otherwise(F.concat(base, F.lit(":duplicate:"), F.col(nth).cast("string")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != "key"], key.alias("key"))


def complete_both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys each side lacks."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").agg(F.count("*").alias("only_left")).crossJoin(b.join(a, key, "left_anti").agg(F.count("*").alias("only_right")))
