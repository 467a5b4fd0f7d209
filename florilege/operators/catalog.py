"""Catalogue queries: facets, search, sorted pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZES = (12, 24, 48)
MOST_WORDS = 12


def search_words(text: str) -> list[str]:
    return text.split()[:MOST_WORDS]


def matching(items: DataFrame, key: str, text: str, columns: list[str], related: list[tuple[DataFrame, str]] = ()) -> DataFrame:
    """Items in which every word of text occurs somewhere: in one of the columns, or in a related row's column (df, column)."""
    out = items
    for word in search_words(text):
        holds = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(word.lower())) for c in columns]
        here = reduce(Column.__or__, holds)
        if not related:
            out = out.where(here)
            continue
        found = [df.where(F.contains(F.lower(F.col(c)), F.lit(word.lower()))).select(F.col(key).alias("_hit")) for df, c in related]
        hits = reduce(DataFrame.union, found).distinct()
        out = out.join(hits, out[key] == hits["_hit"], "left").where(here | F.col("_hit").isNotNull()).drop("_hit")
    return out


def facets(relations: DataFrame, item: str, term: str) -> DataFrame:
    """Distinct items per term."""
    return relations.groupBy(term).agg(F.count_distinct(item).alias("n"))


def page(items: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A sorted page; sizes that aren't offered become the smallest."""
    size = size if size in PAGE_SIZES else PAGE_SIZES[0]
    return items.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def published(items: DataFrame, key: str, collection: str | None = None, relations: DataFrame | None = None, terms: tuple[str, ...] = ()) -> DataFrame:
    """Items (key, status, password, collection, ...) that are published and need no password, of one collection if it is named,
    and with one of the terms if any are: relations are (key, term). An unknown collection or term leaves nothing."""
    out = items.where((F.col("status") == "publish") & (F.coalesce("password", F.lit("")) == ""))
    if collection:
        out = out.where(F.col("collection") == collection)
    if terms:
        out = out.join(relations.where(F.col("term").isin(*terms)).select(key), key, "left_semi")
    return out


def paginated(items: DataFrame, order: list[str], size: int = 50) -> DataFrame:
    """Every item with its place (from 1) and page.

    Places come from range partitions: rows are counted per partition, and only those counts are summed up in one task.
    """
    ranged = items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    from florilege.operators.stored import stored

    ranged = stored(ranged, "pages")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = ranged.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn("place", (F.col("_inside") + F.col("_before")).cast("long"))
    return placed.withColumn("page", F.floor((F.col("place") - 1) / size).cast("long") + 1).drop("_part", "_inside", "_before")


def page_ranges(items: DataFrame, size: int = 50) -> DataFrame:
    """(page, first, last, label) of pages of `size` items; made from the number of items alone."""
    total = items.agg(F.count("*").alias("total")).where("total > 0")
    pages = total.select("total", F.explode(F.sequence(F.lit(1), F.ceil(F.col("total") / size))).alias("page"))
    first, last = (F.col("page") - 1) * size + 1, F.least(F.col("page") * size, F.col("total"))
    return pages.select(F.col("page").cast("long"), first.cast("long").alias("first"), last.cast("long").alias("last"), F.concat_ws("", first.cast("string"), F.lit("–"), last.cast("string"), F.lit(" of "), F.col("total").cast("string")).alias("label"))


def limited_classes(items: DataFrame, flag: str, order: list, when_true: int, when_false: int) -> DataFrame:
    """So many rows of either class, each in order."""
    return items.where(flag).orderBy(*order).limit(when_true).unionByName(items.where(f"NOT {flag}").orderBy(*order).limit(when_false))
