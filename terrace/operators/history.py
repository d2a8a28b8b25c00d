"""Which commits changed the lines of a unit, for all units of all files in one pass.

Neighbouring versions of a file are compared side by side, each pair a row of its own,
so a long history is many small tasks. What is left of a comparison is the list of its
edits. These are then replayed from the newest version back: each unit is an interval of
lines, an edit that touches it is a commit of its history, and the interval is carried
over to the lines that stood there before. One row of edits is held at a time, and the
intervals of one file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.diff import diff_ops, source_lines

#: Commits of a unit that are told.
MAX_COMMITS = 5
EDIT = "struct<old: int, removed: int, new: int, added: int>"
_ARROW_EDIT = pa.list_(pa.struct([("old", pa.int32()), ("removed", pa.int32()), ("new", pa.int32()), ("added", pa.int32())]))


def edits(before: str | None, after: str) -> list[dict]:
    """Runs of changed lines: where they start on either side, from 1, and how many lines each side has."""
    out: list[dict] = []
    i = j = 1
    last = " "
    for op in diff_ops(source_lines(before or ""), source_lines(after)):
        if op != " ":
            if last == " ":
                out.append({"old": i, "removed": 0, "new": j, "added": 0})
            out[-1]["removed" if op == "-" else "added"] += 1
        i, j, last = i + (op != "+"), j + (op != "-"), op
    return out


def carried(start: int, end: int, changes: list[dict]) -> tuple[bool, int, int]:
    """Whether edits touch the lines from ``start`` to ``end``, and where these stood before; nowhere, if the end is before the start.

    Lines that were taken away between two of these touch them, at their edge they don't.
    """
    touched, shift, first, last = False, 0, None, None
    for x in changes:
        stop = x["new"] + x["added"] - 1
        if x["new"] > end:
            break
        if x["added"] == 0:
            if x["new"] > start:
                touched = True
            else:
                shift += x["removed"]
                continue
        elif stop >= start:
            touched = True
            if x["new"] <= start:
                first = x["old"]
            if stop >= end:
                last = x["old"] + x["removed"] - 1
        if first is None and stop < start:
            shift += x["removed"] - x["added"]
    if first is None:
        first = start + shift
    if last is None:
        last = end + sum(x["removed"] - x["added"] for x in changes if x["new"] + max(x["added"], 1) - 1 <= end)
    return touched, first, last


def version_edits(versions: DataFrame) -> DataFrame:
    """file, n, commit, edits of each version against the one before; versions: file, n (from 1, without gaps), commit, source."""
    before = versions.select("file", (F.col("n") + 1).alias("n"), F.col("source").alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [edits(a, b or "") for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, _ARROW_EDIT)], names=["file", "n", "commit", "edits"])

    pairs = versions.join(before, ["file", "n"], "left").select("file", "n", "commit", "before", "source")
    kinds = {c: versions.schema[c].dataType.simpleString() for c in ("file", "n", "commit")}
    return pairs.mapInArrow(run, f"file {kinds['file']}, n {kinds['n']}, commit {kinds['commit']}, edits array<{EDIT}>")


def unit_history(changes: DataFrame, units: DataFrame, most: int = MAX_COMMITS) -> DataFrame:
    """file, unit, rank, commit: the newest ``most`` commits that changed lines of each unit.

    changes: as version_edits gives them. units: file, unit, start, end, in lines of the
    newest version. Units without lines, and of unknown files, have no history. Repeated
    units each give rows; null files match nothing.
    """
    commit, unit = changes.schema["commit"].dataType, units.schema["unit"].dataType
    none = lambda kind: F.lit(None).cast(kind)
    # In each file the units come first, then its versions from the newest back.
    asked = units.filter("file IS NOT NULL AND start <= end").select("file", none("long").alias("n"), none(commit).alias("commit"), none(f"array<{EDIT}>").alias("edits"), "unit", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    told = changes.filter("file IS NOT NULL").select("file", F.col("n").cast("long").alias("n"), "commit", "edits", none(unit).alias("unit"), none("long").alias("start"), none("long").alias("end"))
    ordered = asked.unionByName(told).repartition("file").sortWithinPartitions(F.col("file"), F.col("n").desc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, open_ = None, []
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for file, n, commit, changes, unit, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                if file != here:
                    here, open_ = file, []
                if n is None:
                    open_.append([unit, start, end, 0])
                    continue
                left = []
                for x in open_ if changes else ():
                    touched, x[1], x[2] = carried(x[1], x[2], changes)
                    if touched:
                        x[3] += 1
                        for column, value in zip(out, (file, x[0], x[3], commit)):
                            column.append(value)
                    if x[3] < most and x[1] <= x[2]:
                        left.append(x)
                open_ = left if changes else open_
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], batch.schema.field(4).type), pa.array(out[2], pa.int32()), pa.array(out[3], batch.schema.field(2).type)], names=["file", "unit", "rank", "commit"])

    return ordered.mapInArrow(run, f"file {units.schema['file'].dataType.simpleString()}, unit {unit.simpleString()}, rank int, commit {commit.simpleString()}")


def line_origins(changes: DataFrame, newest: DataFrame) -> DataFrame:
    """file, line, commit: which commit each line of the newest version comes from; newest: file, source."""
    lines = newest.select("file", F.posexplode(F.split(F.regexp_replace("source", "\n$", ""), "\n", -1)).alias("at", "text"))
    units = lines.select("file", (F.col("at") + 1).alias("unit"), (F.col("at") + 1).alias("start"), (F.col("at") + 1).alias("end"))
    return unit_history(changes, units, 1).select("file", F.col("unit").alias("line"), "commit")
