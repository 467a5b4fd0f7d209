"""Joins on ranges: which points lie within which intervals, by blocks of powers of two.

An interval of n places is tiled by at most 2 log n blocks, each of a size 2^k that begins at a multiple of its size; a point lies
in one block of each size. So intervals and points meet by equality of blocks: what is shuffled is either side times a logarithm,
and only true pairs are made, whatever the intervals' lengths. Counts need no pairs at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.operators.dedup import fresh


def _shift(name: str, value: Column, by: Column | int) -> Column:
    return F.call_function(name, value, F.lit(by) if isinstance(by, int) else by)


def tiled(intervals: DataFrame, low: str, high: str, level: str, block: str) -> DataFrame:
    """intervals, a row for each block that tiles [low, high]; empty intervals have none."""
    first, after = F.col(low).cast("long"), F.col(high).cast("long") + 1
    # the largest block isn't longer than the interval
    levels = F.sequence(F.lit(0), F.floor(F.log2((after - first).cast("double"))).cast("int"))
    rows = intervals.where(after > first).withColumn(level, F.explode(levels))
    one = F.lit(1).cast("long")
    begin = _shift("shiftright", first + _shift("shiftleft", one, F.col(level)) - 1, F.col(level))
    end = _shift("shiftright", after, F.col(level))
    left = F.when((begin < end) & (begin % 2 == 1), begin)
    right = F.when((begin < end) & (end % 2 == 1), end - 1)
    return rows.withColumn(block, F.explode(F.array_compact(F.array(left, right))))


def _placed(points: DataFrame, point: str, top: int, level: str, block: str) -> DataFrame:
    """points (places from 0 on), a row for each block that they lie in, up to a size of 2^top."""
    rows = points.where(F.col(point) >= 0).withColumn(level, F.explode(F.sequence(F.lit(0), F.lit(top))))
    return rows.withColumn(block, _shift("shiftright", F.col(point).cast("long"), F.col(level)))


def _top(intervals: DataFrame, low: str, high: str) -> int:
    longest = intervals.agg(F.max(F.col(high) - F.col(low) + 1)).first()[0]
    return max(0, int(longest or 1).bit_length() - 1)


def pairs_within(intervals: DataFrame, points: DataFrame, keys: list[str], low: str, high: str, point: str) -> DataFrame:
    """Rows of intervals with rows of points of the same keys whose point lies in [low, high]. Other columns' names must differ."""
    level, block = (fresh(n, [*intervals.columns, *points.columns]) for n in ("level", "block"))
    tiles = tiled(intervals, low, high, level, block)
    return tiles.join(_placed(points, point, _top(intervals, low, high), level, block), [*keys, level, block]).drop(level, block)


def counts_within(intervals: DataFrame, points: DataFrame, keys: list[str], low: str, high: str, point: str, by: list[str], name: str = "n") -> DataFrame:
    """Per row of intervals (which must differ) and value of `by` (columns of points): how many points lie in [low, high]; rows
    without any are left out. Points are counted by block first."""
    level, block = (fresh(n, [*intervals.columns, *points.columns, name]) for n in ("level", "block"))
    held = _placed(points.select(*keys, point, *by), point, _top(intervals, low, high), level, block).groupBy(*keys, level, block, *by).agg(F.count("*").alias(name))
    tiles = tiled(intervals, low, high, level, block)
    return tiles.join(held, [*keys, level, block]).groupBy(*intervals.columns, *by).agg(F.sum(name).alias(name))
