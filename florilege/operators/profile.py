"""Profiles: frequencies, first examples, occurrence numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequencies(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows per combination of keys as n; partial counts are made before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def bucket(column: str | Column, default: str) -> Column:
    """A value, or the name of the bucket for null and empty ones."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(F.coalesce(column, F.lit("")) == "", F.lit(default)).otherwise(column)


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "ordinal") -> DataFrame:
    """The place of each row within its key, from 1; order must be total."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def first_n(df: DataFrame, keys: list[str], order: list, n: int, name: str = "ordinal") -> DataFrame:
    """The first n rows of each key. Spark limits each task's rows by key before it shuffles, so a hot key moves few rows."""
    return numbered(df, keys, order, name).where(F.col(name) <= n)


def with_examples(df: DataFrame, keys: list[str], example: list[str], n: int) -> DataFrame:
    """Rows per key, and the n first examples in the order of their columns, joined as text."""
    text = F.concat_ws("@", *[F.col(c).cast("string") for c in example])
    # rows are counted by key and example, before the shuffle; both results come of that one (the filter keeps the counts there)
    counted = frequencies(df, *keys, *example)
    first = first_n(counted.where("n > 0"), keys, [F.col(c) for c in example], n)
    shown = first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", text.alias("t")))), lambda s: s["t"]), " | ").alias("examples"))
    return counted.groupBy(*keys).agg(F.sum("n").alias("n")).join(shown, keys)


def by_sets(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts by nothing, by each key and by both, in one pass; level tells which (0: both, 3: all)."""
    return df.groupingSets([[], [first], [second], [first, second]], first, second).agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def out_of_sequence(df: DataFrame, key: str, order: str, number: str) -> DataFrame:
    """Keys whose numbers, in the order given, are repeated or fall back."""
    before = F.lag(number).over(Window.partitionBy(key).orderBy(order))
    flagged = df.select(key, (F.col(number) <= before).alias("bad"))
    return flagged.groupBy(key).agg(F.sum(F.when(F.col("bad"), 1).otherwise(0)).cast("long").alias("breaks")).where("breaks > 0")


def summary(df: DataFrame, **indicators: Column) -> DataFrame:
    """One row (indicator, value) per indicator, all from one pass."""
    wide = df.agg(*[value.cast("long").alias(name) for name, value in indicators.items()])
    return wide.unpivot([], list(indicators), "indicator", "value")
