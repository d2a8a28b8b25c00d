"""What two snapshots have in common is worked out once.

A store keeps what was read from each distinct file content; a snapshot parses only
what the store lacks. Edges that names resolve to are kept with the number of uses
behind them, so a change adds and takes away counts where files or definitions differ
and leaves the rest alone.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import go_refs, parsers
from ..functions.text import content_digest
from ..staging import shared_dir, stage


class ParseStore:
    """Units and references by the digest of a path and its content, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_dir(spark)}/parsed-{uuid.uuid4().hex}"
        self.batches: list[str] = []

    def _kept(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{name}/{b}" for b in self.batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def digests(self) -> DataFrame:
        """digest of all that has been parsed."""
        return self._kept("keys", "digest string")

    def parsed(self, files: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """(units, references, how many contents were parsed) of files (path, source).

        A batch is known only after all its tables are written, so one that failed is parsed again.
        """
        keyed = stage(files.select("path", "source", content_digest(F.col("path"), F.coalesce("source", F.lit(""))).alias("digest")), "keyed")
        fresh = stage(keyed.dropDuplicates(["digest"]).join(self.digests(), "digest", "left_anti"), "fresh")
        n = fresh.count()
        if n:
            batch, of = uuid.uuid4().hex, fresh.select("path", "digest")
            for name, rows in (("units", parsers.parse_units(fresh)), ("refs", go_refs.reference_table(fresh))):
                rows.join(of, "path").write.parquet(f"{self.folder}/{name}/{batch}")
            of.select("digest").write.parquet(f"{self.folder}/keys/{batch}")
            self.batches.append(batch)
        own = keyed.select("path", "digest")
        kept = [self._kept(name, schema + ", digest string") for name, schema in (("units", parsers.UNITS), ("refs", go_refs.REFS))]
        units, refs = (k.join(own, ["path", "digest"], "left_semi").select(*(c for c in k.columns if c != "digest")) for k in kept)
        return units, refs, n


def definitions(defs: DataFrame) -> DataFrame:
    """name, target: names that one row alone defines; defs: file, name, target."""
    return defs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("target").alias("target")).filter("n = 1").drop("n")


def edge_counts(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """src, dst, kind, n: resolved from nothing; uses: file, src, name, kind."""
    return uses.join(definitions(defs), "name").groupBy("src", F.col("target").alias("dst"), "kind").agg(F.count(F.lit(1)).alias("n"))


def changed_counts(edges: DataFrame, uses: tuple[DataFrame, DataFrame], defs: tuple[DataFrame, DataFrame], files: DataFrame) -> DataFrame:
    """``edges`` brought up to date; uses and defs: all rows before and after; files: those that changed, came or went (file).

    Uses in these files are counted out and in by the definitions of before and after.
    Uses elsewhere change only where a name that one of these files defines, or defined,
    now means something else.
    """
    files = files.select("file").distinct()
    touched = lambda df: df.join(files, "file", "left_semi")
    named = stage(touched(defs[0]).select("name").unionByName(touched(defs[1]).select("name")).distinct(), "names")
    about = lambda df: definitions(df.join(named, "name", "left_semi"))
    old, new = about(defs[0]).withColumnRenamed("target", "was"), about(defs[1]).withColumnRenamed("target", "is")
    moved = stage(named.join(old, "name", "left").join(new, "name", "left").filter("NOT (was <=> is)"), "moved")

    def counted(rows: DataFrame, target: Column, sign: int) -> DataFrame:
        return rows.select("src", target.alias("dst"), "kind", F.lit(sign).cast("long").alias("n")).filter("dst IS NOT NULL")

    # Of the names that uses in these files have, those that did not move mean the same before and after.
    wanted = touched(uses[0]).select("name").unionByName(touched(uses[1]).select("name")).distinct()
    same = definitions(defs[1].join(wanted, "name", "left_semi"))
    before, after = touched(uses[0]), touched(uses[1])
    kept = lambda df: df.join(moved.select("name"), "name", "left_anti").join(same, "name")
    parts = [counted(kept(before), F.col("target"), -1), counted(kept(after), F.col("target"), 1), counted(uses[0].join(moved, "name"), F.col("was"), -1), counted(uses[1].join(moved, "name"), F.col("is"), 1)]
    delta = reduce(DataFrame.unionByName, parts).groupBy("src", "dst", "kind").agg(F.sum("n").alias("n")).filter("n <> 0")
    return edges.select("src", "dst", "kind", "n").unionByName(delta).groupBy("src", "dst", "kind").agg(F.sum("n").alias("n")).filter("n > 0")
