"""Totals with subtotals, and distinct counts from sketches that can be merged.

A sketch for each finest group is kept; those of coarser groups, and of several
snapshots, are unions of them, so nothing is read again for a subtotal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch, as a power of two: a standard error of about 0.8 percent.
SKETCH_BITS = 14


def sketched(rows: DataFrame, keys: list[str], distinct: str, amount: str) -> DataFrame:
    """keys, n, amount, sketch: the finest groups. Null values are not counted as distinct, null amounts as nothing."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(amount), F.lit(0)).alias("amount"), F.hll_sketch_agg(distinct, F.lit(SKETCH_BITS)).alias("sketch"))


def rolled_up(groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, depth, n, amount, distinct: of all rows (depth 0), by the first key, by the first two, and so on.

    ``depth`` tells a subtotal from a group whose key is null. groups: as ``sketched``
    gives them, of one snapshot or several.
    """
    bits = F.bit_count(F.grouping_id()) if len(keys) > 1 else F.grouping(keys[0])
    totals = groups.rollup(*keys).agg(bits.alias("above"), F.sum("n").alias("n"), F.sum("amount").alias("amount"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))
    return totals.select(*keys, (F.lit(len(keys)) - F.col("above")).cast("int").alias("depth"), "n", "amount", "distinct")
