"""Streaming extensions: change counts over event time, and session budgets with state.

Neither has a counterpart among the batch operators: these are extensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, event_type, changes in each window of ``ts``; rows later than ``late`` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("changes"))
    return counts.select(F.col("window.start").alias("start"), "event_type", "changes")


def budget_stream(requests: DataFrame, limit: int) -> DataFrame:
    """session, n, cost, admitted, used: requests admitted in order of ``n`` while a session's budget lasts; its use is kept between batches."""

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("n")
        out = []
        for n, cost in zip(rows["n"], rows["cost"]):
            fits = used + cost <= limit
            used += int(cost) if fits else 0
            out.append((key[0], int(n), int(cost), bool(fits), int(used)))
        state.update((int(used),))
        yield pd.DataFrame(out, columns=["session", "n", "cost", "admitted", "used"])

    return requests.groupBy("session").applyInPandasWithState(admit, "session long, n long, cost long, admitted boolean, used long", "used long", "append", "NoTimeout")
