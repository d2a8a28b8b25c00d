"""Building blocks that the other operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row that comes first by ``order`` for each key.

    An aggregate, not a window: each task keeps one row a key before the shuffle,
    so a key that holds much of the input is no hot partition.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
    return best.select(*keys, *(F.col("__first")[c].alias(c) for c in rest)).select(*df.columns)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each key, numbered from 1 in ``name``; Spark keeps k rows a task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def top_overall(df: DataFrame, order: list[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows of all, numbered from 1: a distributed top-k, then a window over k rows."""
    return df.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def islands(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Number, from 1, the stretches of equal ``value`` along ``order`` within each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = F.when(F.row_number().over(w) == 1, 1).when(value.eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("__fresh", fresh).withColumn(name, F.sum("__fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fresh")


def to_first_over(df: DataFrame, keys: list[str], order: list[Column], size: Column, limit: int) -> DataFrame:
    """Of each key the rows in order up to and with the first that takes the running size over ``limit``.

    Each part of the input is cut first, so a hot key meets in one task only with what
    its parts have left. The row that goes over stays: what comes later in another part
    must still be counted after it.
    """
    part = "__part"
    before = lambda *by: F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = df.withColumn(part, F.spark_partition_id()).withColumn("__before", before(*keys, part)).filter(F.col("__before") <= limit).drop(part)
    return cut.withColumn("__before", before(*keys)).filter(F.col("__before") <= limit).drop("__before")


def greedy_prefix(df: DataFrame, keys: list[str], order: list[Column], size: Column, limit: int) -> DataFrame:
    """Rows in order until the first that would take the running size over ``limit``; sizes are not negative.

    ``used`` is the running size; rows that ``order`` leaves equal count together, as in SQL.
    A null size adds nothing.
    """
    used = F.sum(size).over(Window.partitionBy(*keys).orderBy(*order))
    return to_first_over(df, keys, order, size, limit).withColumn("used", used).filter(F.col("used") <= limit)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
