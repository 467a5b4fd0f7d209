"""Connected components of an edge table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import materialised


def _hooked(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u's neighbourhood. A hub's edges are joined, not grouped, so they can be split."""
    return edges.join(least, "u")


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component_id) for every id of edges (a, b); component_id is the smallest id reachable.

    Loops and repeated edges don't matter; nulls must not occur. Each round is written to the shared folder.
    """
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = materialised(oriented, "edges")
    if state.isEmpty():
        return state.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    before = None
    for _ in range(rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _hooked(both.where("v > u"), least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _hooked(large, least).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        state = materialised(small, "small")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    roots = state.select(F.col("v").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return state.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots)
