"""Shared plumbing: what workers keep, batches in small parts, broadcasts of counted size."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import PART_BYTES, modest_batches, shared_dir, slices, stage, unstage

__all__ = ["ASCII_SPACE", "PART_BYTES", "Store", "few", "free_name", "kept_in_worker", "lower_ascii", "modest_batches", "shared_dir", "shuffle_width", "slices", "stage", "table", "unstage"]

#: Characters that count as white space wherever a contract speaks of ASCII white space.
ASCII_SPACE = r"[\x20\x09-\x0D]"
#: Bytes, at most, that a store in a worker holds.
STORE_BYTES = 24_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    """Lower-case A-Z alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Store(dict):
    """Key -> ``make`` of it, found once; emptied when it holds ``most`` bytes."""

    def __init__(self, make: Callable[[Any], Any], most: int = STORE_BYTES):
        super().__init__()
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key: Any) -> Any:
        value = self.make(key)
        cost = sys.getsizeof(key) + sys.getsizeof(value) + 100  # and its place in the table
        if cost > self.most // 16:
            return value
        if self.held + cost > self.most:
            self.clear()
            self.held = 0
        self.held += cost
        self[key] = value
        return value


_KEPT: dict[str, Any] = {}
_OWNER = ""


def kept_in_worker(operator: str, name: str = "", make: Callable[[], Any] | None = None) -> Any:
    """What ``operator`` keeps in a Python worker from one task to the next; what others left there goes first."""
    global _OWNER
    if operator != _OWNER:
        _KEPT.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _OWNER = operator
    if make is not None and name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT.get(name)


#: Rows of a few numbers each, and bytes of others, at most, that a join may send to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32_000_000


def few(df: DataFrame, tag: str, size: Column | None = None) -> DataFrame:
    """``df``, written; marked for broadcast if it has few rows and, where ``size`` tells those of a row, few bytes. Otherwise a join shuffles as usual."""
    out = stage(df, tag)
    rows, held = out.agg(F.count(F.lit(1)), F.sum(F.lit(0) if size is None else size)).first()
    return F.broadcast(out) if rows <= BROADCAST_ROWS and (held or 0) <= BROADCAST_BYTES else out
