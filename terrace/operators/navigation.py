"""Tours: bounded, ordered walks over ranked units."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import bounded, stage
from .graph import FOLLOWED, rank_order, ranked, read_next
from .relational import top_k, top_overall, union_all

STOPS = 16


def breadth_first(starts: DataFrame, steps: DataFrame | Callable[[DataFrame], DataFrame], nodes: DataFrame, most: int = STOPS) -> DataFrame:
    """stop_no, id, depth: first-in first-out order from ``starts`` (id, rank) along ``steps`` (id, target, rank), or what ``steps`` gives for a level's ids.

    Level by level: a node's spot is the list of ranks on its way, and a level's
    order is that of the lists. Nodes that are no stops are walked through but not
    counted, so no level is cut. Levels are written tables; only stops, at most
    ``most``, reach the driver, and the walk ends when they are found.
    """
    spark = nodes.sparkSession
    stops = nodes.filter(F.col("is_unit") & (F.col("language") != "document")).select(F.col("id").alias("stop"))
    level = stage(starts.groupBy("id").agg(F.min(F.array(F.col("rank").cast("long"))).alias("spot")), "level")
    seen, found = level.select("id"), []
    for depth in count():
        # A level has each id once, and is small beside the nodes, which are not shuffled where it is sent to them.
        here = top_overall(stops.join(bounded(level), F.col("id") == F.col("stop")).select("id", "spot").distinct(), [F.col("spot"), F.col("id")], most - len(found), "n")
        found += [(len(found) + r["n"], r["id"], depth) for r in here.select("n", "id").collect()]
        if len(found) >= most:
            break
        near = steps(level.select("id")) if callable(steps) else steps
        near = near.select(F.col("id").alias("parent"), "target", F.col("rank").cast("long").alias("rank"))
        nexts = level.join(near, F.col("id") == F.col("parent")).select(F.col("target").alias("id"), F.concat("spot", F.array("rank")).alias("spot"))
        nexts = nexts.join(seen.select(F.col("id").alias("old")), F.col("id") == F.col("old"), "left_anti")
        level = stage(nexts.groupBy("id").agg(F.min("spot").alias("spot")), "level")
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("id"))
    return spark.createDataFrame(found, "stop_no int, id string, depth int")


def followed_steps(nodes: DataFrame, edges: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """For a level's ids: id, target, rank, the neighbours a tour goes on to, of the twelve that are nearest."""
    return lambda of: read_next(nodes, edges, of=of).filter(F.col("relationship").isin(*FOLLOWED)).select("id", "target", "rank")


def ranks(units: DataFrame) -> DataFrame:
    """id, rank: all ``units`` in order of rank, numbered without gaps; ranges are sorted apart and counted, so no task sees them all."""
    placed = units.select(F.struct(*(c.alias(f"k{n}") for n, c in enumerate((-F.col("score"), F.col("path"), F.col("start"), F.col("id"))))).alias("key"), "id")
    runs = stage(placed.repartitionByRange("key").sortWithinPartitions("key").withColumn("row", F.monotonically_increasing_id()), "runs")
    runs = runs.withColumn("part", F.shiftright("row", 33)).withColumn("at", F.col("row").bitwiseAND((1 << 33) - 1))
    sizes = runs.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select(F.col("part").alias("p"), (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # one row a range
    return runs.join(F.broadcast(before), F.col("part") == F.col("p")).select("id", (F.col("before") + F.col("at") + 1).alias("rank"))


def architecture(nodes: DataFrame, edges: DataFrame, most: int = STOPS, fill: bool = True) -> DataFrame:
    """stop_no, id: entry points and what follows from them, then the best of the rest.

    Without an entry point the best-ranked unit starts, if ``fill``; an execution
    tour (``fill`` false) then is empty.
    """
    units = ranked(nodes)
    entries = units.filter(F.array_contains("roles", "entry point"))
    if fill and entries.isEmpty():
        entries = units.orderBy(*rank_order()).limit(1)
    starts = ranks(entries)
    walked = breadth_first(starts, followed_steps(nodes, edges), nodes, most).select(F.lit(0).alias("part"), F.col("stop_no").alias("ord"), "id")
    if fill:
        rest = top_overall(units.filter(~F.array_contains("roles", "test support")), rank_order(), 2 * most, "ord")
        walked = walked.unionByName(rest.select(F.lit(1).alias("part"), "ord", "id"))
    return numbered_stops(walked.withColumn("spot", F.struct("part", "ord")), most)


def numbered_stops(rows: DataFrame, most: int = STOPS) -> DataFrame:
    """stop_no, id: each id once, at its first spot, the first ``most``."""
    once = rows.groupBy("id").agg(F.min("spot").alias("spot"))
    return top_overall(once, [F.col("spot"), F.col("id")], most, "stop_no").select("stop_no", "id")


#: Roles that hold data or state.
STATE_ROLES = ("storage boundary", "configuration", "resource", "variable", "output")


def state(nodes: DataFrame, most: int = STOPS) -> DataFrame:
    hits = ranked(nodes).filter(F.arrays_overlap("roles", F.array(*map(F.lit, STATE_ROLES))))
    return top_overall(hits, rank_order(), most, "stop_no").select("stop_no", "id")


def testing(nodes: DataFrame, edges: DataFrame, most: int = STOPS) -> DataFrame:
    """Units and the tests that call them in turn, by rank; then declared tests.

    Many pairs of a unit and a test share one of them, so each stop is first
    reduced to its earliest spot, and only then are the first taken.
    """
    units = ranked(nodes).select("id", "path", "start", "score", "roles")
    place = F.struct((-F.col("score")).alias("s"), F.col("path").alias("p"), F.col("start").alias("l"), F.col("id").alias("i"))
    tested = edges.filter("kind = 'tested-by'").select("src", "dst")
    # Each of the first ``most`` tested units is a stop, and comes before all that later ones lead to.
    best = top_overall(units.join(tested.select("src").distinct(), F.col("id") == F.col("src"), "left_semi"), rank_order(), most, "n")
    tested = tested.join(F.broadcast(best.select(F.col("id").alias("src"), place.alias("place"))), "src")  # most rows
    stop = units.select(F.col("id").alias("ok"))
    spot = lambda n: F.struct(F.lit(0).alias("part"), "place", F.col("dst").alias("d"), F.lit(n).alias("n")).alias("spot")
    first = tested.select(F.col("src").alias("id"), spot(0))
    second = tested.select(F.col("dst").alias("id"), spot(1)).join(stop, F.col("id") == F.col("ok"), "left_semi")
    declared = units.filter(F.array_contains("roles", "test")).select("id", F.struct(F.lit(1).alias("part"), place.alias("place"), F.lit("").alias("d"), F.lit(0).alias("n")).alias("spot"))
    return numbered_stops(union_all([first, second, declared]), most)


def recent_files(log: DataFrame, indexed: DataFrame, commits: int = 30) -> DataFrame:
    """path, ord of the indexed files in the newest commits; log: ts, commit, paths (array); ties by commit."""
    newest = top_overall(log, [F.col("ts").desc(), F.col("commit")], commits, "commit_ord")
    each = newest.select("commit_ord", F.posexplode("paths").alias("at", "path"))
    first = each.groupBy("path").agg(F.min(F.struct("commit_ord", "at")).alias("spot"))
    hits = first.join(indexed.select("path"), "path", "left_semi")
    return hits.withColumn("ord", F.row_number().over(Window.orderBy("spot", "path"))).select("path", "ord")  # the files of 30 commits


def recent(nodes: DataFrame, files: DataFrame, most: int = STOPS) -> DataFrame:
    """The best-ranked unit of each recent file, in the files' order."""
    near = ranked(nodes).select("id", "path", "start", "score").join(F.broadcast(files), "path")  # the files of 30 commits
    best = top_k(near, ["path"], rank_order(), 1, "n")
    return numbered_stops(best.select("id", F.struct("ord").alias("spot")), most)
