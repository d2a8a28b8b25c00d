"""Points and the ranges that hold them, by a sweep.

Points and the starts of ranges are sorted together within blocks of SPAN places of
a key, so a hot key falls to many tasks; a range is there once for each block that it
reaches. One pass over a block keeps the open ranges in a heap, first by ``ord``; ended
ones leave it when they come to its top. No point ever meets a range that it isn't in.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Places of a key that one task sweeps.
SPAN = 8192


def first_range(points: DataFrame, ranges: DataFrame, keys: list[str], at: str = "line") -> DataFrame:
    """Each point with ``unit``: the first range of its key, by ord and then unit, that holds it; null where none does.

    ranges: keys, start, end, ord, unit (a string). Points with a null key or place,
    and ranges that end before they start or lack a bound, hold and are held by none.
    """
    cols = points.columns
    block = lambda c: F.floor(F.col(c) / SPAN)
    fine = ranges.filter("start <= end").select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("ord").cast("long").alias("ord"), F.col("unit").cast("string").alias("unit"))
    starts = fine.withColumn("block", F.explode(F.sequence(block("start"), block("end")))).withColumn("spot", F.greatest("start", F.col("block") * SPAN))
    held = F.struct(*cols)
    events = starts.select(*(F.col(k).alias(f"k{n}") for n, k in enumerate(keys)), "block", "spot", F.lit(0).alias("turn"), "end", "ord", "unit", F.lit(None).cast(points.select(held.alias("p")).schema["p"].dataType).alias("p"))
    asked = points.select(*(F.col(k).alias(f"k{n}") for n, k in enumerate(keys)), block(at).alias("block"), F.col(at).cast("long").alias("spot"), F.lit(1).alias("turn"), F.lit(None).cast("long").alias("end"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("unit"), held.alias("p"))
    place = [f"k{n}" for n in range(len(keys))] + ["block"]
    ordered = events.unionByName(asked).repartition(*place).sortWithinPartitions(*place, "spot", "turn")
    n_place = len(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, heap = None, []
        for batch in batches:
            told = list(zip(*(batch.column(n).to_pylist() for n in range(n_place))))
            spots, turns, ends, ords, units = (batch.column(n_place + n).to_pylist() for n in range(5))
            rows, found = [], []
            for n, key in enumerate(told):
                if key != here:
                    here, heap = key, []
                if turns[n] == 0:
                    heapq.heappush(heap, (ords[n] is None, ords[n] or 0, units[n] or "", ends[n], units[n]))
                    continue
                while heap and (spots[n] is None or heap[0][3] < spots[n]):
                    heapq.heappop(heap)
                rows.append(n)
                found.append(heap[0][4] if heap and None not in key else None)
            taken = batch.column(n_place + 5).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.flatten(), pa.array(found, pa.string())], names=[*cols, "unit"])

    schema = StructType([*points.schema.fields]).add("unit", StringType())
    return ordered.mapInArrow(run, schema)
