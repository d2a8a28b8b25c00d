"""Events as they come: sessions, and pairs of events within a span of time.

Both take streams or tables alike; of a stream, rows later than the watermark are left
out, and state is dropped once no row that may still come can need it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, start, end, events: stretches of a key's events in which none is further than ``gap`` from the next; ``end`` is a gap after the last."""
    known = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    known = known.withWatermark(at, late) if events.isStreaming else known
    found = known.groupBy(F.session_window(at, gap).alias("session"), key).agg(F.count(F.lit(1)).alias("events"))
    return found.select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "events")


def followed(first: DataFrame, then: DataFrame, key: str, at: str, after: str, span: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Pairs of rows of one key where ``after`` (of ``then``) is no earlier than ``at`` (of ``first``) and within ``span`` of it.

    Both streams have watermarks, so a row of ``first`` is kept until its span is over and
    a row of ``then`` until no earlier row can come. Other columns must differ in name.
    """
    if first.isStreaming:
        first, then = first.withWatermark(at, late), then.withWatermark(after, late)
    right = then.withColumnRenamed(key, "__key")
    near = (F.col(after) >= F.col(at)) & (F.col(after) <= F.col(at) + F.expr(f"INTERVAL {span}"))
    return first.join(right, (F.col(key) == F.col("__key")) & near).drop("__key")
