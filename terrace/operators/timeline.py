"""Joins along time: the latest row before another, and rows within a span of time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from ..staging import stage


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, ties: list[str]) -> DataFrame:
    """Each row of ``left`` with the other columns of the latest row of ``right`` of its keys whose ``since`` isn't after ``at``; nulls where there is none.

    Of rows of one time the greatest by ``ties`` counts. Both sides are sorted together
    by range, so a hot key falls to many tasks; each carries the last row of ``right`` on,
    and rows that stand before the first one of their range take the last one of the
    ranges before, of which one row a range goes through the driver. Rows of ``left``
    repeat as they do there; null keys and times find and are nothing.
    """
    spark, told = left.sparkSession, [c for c in right.columns if c not in keys]
    held, kept = F.struct(*left.columns), F.struct(*told)
    right = right.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, since])).groupBy(*keys, since).agg(F.max_by(kept, F.struct(*ties)).alias("r"))
    key = F.when(F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, at])), F.to_json(F.struct(*keys))).alias("k")
    r_type, l_type = right.schema["r"].dataType, left.select(held.alias("l")).schema["l"].dataType
    events = left.select(key, F.col(at).alias("t"), F.lit(1).alias("turn"), F.lit(None).cast(r_type).alias("r"), held.alias("l"))
    events = events.unionByName(right.select(F.to_json(F.struct(*keys)).alias("k"), F.col(since).alias("t"), F.lit(0).alias("turn"), "r", F.lit(None).cast(l_type).alias("l")))
    ordered = events.repartitionByRange("k", "t", "turn").sortWithinPartitions("k", "t", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, here, last = TaskContext.get().partitionId(), None, None, None
        for n_batch, batch in enumerate(b for b in batches if b.num_rows):
            names, turns = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            seen = pa.concat_arrays([last if last is not None else batch.column(3).slice(0, 1), batch.column(3)])
            spot = 0 if last is not None else None  # place of the last row of the right side in ``seen``
            rows, found, open_ = [], [], []
            first = names[0] if n_batch == 0 else first
            for n, (name, turn) in enumerate(zip(names, turns)):
                if name != here:
                    here, spot = name, None
                if turn == 0:
                    spot = n + 1
                    continue
                rows.append(n)
                found.append(spot)
                open_.append(spot is None and name is not None and name == first)
            last = seen.slice(spot, 1) if spot is not None else None
            yield pa.RecordBatch.from_arrays([batch.column(4).take(pa.array(rows, pa.int64())), seen.take(pa.array(found, pa.int64())), pa.array(open_, pa.bool_()), pa.array([part] * len(rows), pa.int64()), pa.array([None] * len(rows), pa.string()), pa.array([None] * len(rows), pa.string())], names=["l", "r", "open", "part", "first", "last"])
        if first is not None or here is not None:  # what the next range takes over
            carry = last if last is not None else pa.nulls(1, batch.schema.field(3).type)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, batch.schema.field(4).type), carry, pa.array([None], pa.bool_()), pa.array([part], pa.int64()), pa.array([first], pa.string()), pa.array([here], pa.string())], names=["l", "r", "open", "part", "first", "last"])

    schema = StructType().add("l", l_type).add("r", r_type).add("open", BooleanType()).add("part", LongType()).add("first", "string").add("last", "string")
    swept = stage(ordered.mapInArrow(run, schema), "swept")
    carry, rows = (None, None), []
    for x in swept.filter("open IS NULL").select("part", "first", "last", "r").orderBy("part").collect():  # one row a range
        if carry[0] is not None and carry[0] == x["first"]:
            rows.append((x["part"], carry[1]))
        if x["r"] is not None:
            carry = (x["last"], x["r"])
        elif x["first"] != x["last"] or carry[0] != x["last"]:
            carry = (None, None)
    taken = spark.createDataFrame(rows, StructType().add("p", LongType()).add("before", r_type))
    out = swept.filter("open IS NOT NULL").join(F.broadcast(taken), F.col("open") & (F.col("part") == F.col("p")), "left")
    return out.select("l.*", F.coalesce("r", "before").alias("r")).select(*left.columns, *(F.col("r")[c].alias(c) for c in told))


def within(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, seconds: int) -> DataFrame:
    """Pairs of rows of equal keys where ``since`` is at most ``seconds`` before ``at``, and not after it.

    Time is cut into stretches as long as the span, so a row meets those of its own
    stretch and the one before only. Other columns must differ in name.
    """
    stretch = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    spread = right.withColumn("__stretch", F.explode(F.array(stretch(since), stretch(since) + 1)))
    met = left.withColumn("__stretch", stretch(at)).join(spread, [*keys, "__stretch"]).drop("__stretch")
    return met.filter((F.col(since) <= F.col(at)) & (F.col(since) >= F.col(at) - F.expr(f"INTERVAL {seconds} SECONDS")))
