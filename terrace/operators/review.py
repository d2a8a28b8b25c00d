"""Comparison of two snapshots.

units: id, path, kind, language, name, start, source. edges: src, dst, kind.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_digest, plural
from ..staging import stage
from .ranges import first_range
from .relational import top_k, top_overall, union_all

#: Fixed values.
RENAME_THRESHOLD, MAX_RELATED, MAX_STOPS = 0.7, 12, 32
PHRASES = {"unchanged-callers": "are called from code that did not change with them", "tests-changed": "have tests that changed with them", "tests-unchanged": "have tests that did not change"}
#: Sizes within this factor of one another are one cell.
CELL = 1.3


def compare(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, status, and before_/after_ of each field, of rows that differ; status: added, removed, modified.

    Fields compare null-safely; a full outer join on the key, nothing else.
    """
    b = before.select(F.col(key).alias("b_key"), F.struct(*fields).alias("b"))
    a = after.select(F.col(key).alias("a_key"), F.struct(*fields).alias("a"))
    joined = b.join(a, F.col("b_key") == F.col("a_key"), "full").filter(~F.col("b").eqNullSafe(F.col("a")))
    status = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("modified")
    return joined.select(F.coalesce("a_key", "b_key").alias(key), status.alias("status"), *(F.col(f"b.{f}").alias(f"before_{f}") for f in fields), *(F.col(f"a.{f}").alias(f"after_{f}") for f in fields))


def relationship_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """src, kind, dst, change: edges that only one side has."""
    key = ["src", "kind", "dst"]
    b, a = before.select(*key).distinct(), after.select(*key).distinct()
    return a.join(b, key, "left_anti").withColumn("change", F.lit("added")).unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("removed")))


def cohort(path: Column, language: Column, kind: Column) -> Column:
    """The order in which changes are read."""
    return F.when(path.endswith("_test.go"), "3 · tests").when(language == "document", "4 · documentation").when(kind == "type", "1 · types and contracts").otherwise("2 · implementation and file context")


def change_id(node_id: Column, status: Column, before: Column, after: Column) -> Column:
    return F.substring(content_digest(node_id, status, before, after), 1, 16)


def generated(path: Column, source: Column) -> Column:
    """Whether a marker line stands before the package clause."""
    head = F.element_at(F.split(source, r"(?m)^package ", 2), 1)
    return path.endswith(".go") & head.rlike(r"(?m)^// Code generated .* DO NOT EDIT\.$")


def outside(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """Lines (path, line, text) that no range (path, start, end) covers."""
    spans = ranges.select("path", "start", "end", F.lit(0).alias("ord"), F.lit("").alias("unit"))
    return first_range(lines, spans, ["path"]).filter("unit IS NULL").drop("unit")


def mutual_best(scores: DataFrame, least: float = RENAME_THRESHOLD) -> DataFrame:
    """old, new, score: pairs that are each other's only best, at ``least`` or more; a tie for first is no match."""

    def best(side: str) -> DataFrame:
        w = Window.partitionBy(side).orderBy(F.col("score").desc())
        placed = scores.select("old", "new", "score", F.row_number().over(w).alias("n"), F.lead("score").over(w).alias("second"))
        return placed.filter((F.col("n") == 1) & (F.col("score") >= least) & (F.col("score") > F.coalesce("second", F.lit(0.0)))).select("old", "new", "score")

    return best("old").join(best("new").select("old", "new"), ["old", "new"])


def rename_candidates(changes: DataFrame, least: float = RENAME_THRESHOLD) -> DataFrame:
    """Removed and added units of one kind and language that may score ``least`` or more, paired.

    A unit's lines, trimmed and with a mark for its own name, are a set of (line, how often
    before). Two bodies that are alike share a part of these sets, so they meet in one of
    the first lines of either, rarest first, that leave room for that part; only units of
    fitting size meet there. Bodies that are equal but for the name meet as a whole; of more
    than two of a side, which tie whatever they are compared with, two stand for all. A line
    with both names counts as different when pairs are sought.
    """

    def side(status: str, name: str, source: str) -> DataFrame:
        own = changes.filter(F.col("status") == status).select(F.lit(name).alias("side"), "id", "kind", "language", F.col("name"), F.col(source).alias("source"))
        short = F.element_at(F.split(F.element_at(F.split(F.trim("name"), r"\s+"), -1), r"\."), -1)
        text = F.regexp_replace(F.coalesce("source", F.lit("")), "\n$", "")
        pattern = F.concat(F.lit(r"(?U)(?<!\w)\Q"), short, F.lit(r"\E(?!\w)"))
        clean = lambda t: F.transform(F.split(t, "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
        marked = F.when(short == "", text).otherwise(F.regexp_replace(text, pattern, F.lit("\0")))
        return own.select("side", "id", "kind", "language", "name", "source", clean(marked).alias("lines"), clean(text).alias("plain"))

    both = stage(side("removed", "old", "before_source").unionByName(side("added", "new", "after_source")).withColumn("body", F.xxhash64(F.array_join("lines", "\n"))), "bodies")
    # Of equal bodies two a side are enough to tell a tie.
    few = top_k(both.select("kind", "language", "body", "side", "id"), ["kind", "language", "body", "side"], [F.col("id")], 2, "copy").select("id", "side")
    both = stage(both.join(few, ["id", "side"], "left_semi"), "bodies")
    named = lambda c: both.filter(F.col("side") == c).select("kind", "language", "body", F.col("id").alias(c))
    equal = named("old").join(named("new"), ["kind", "language", "body"]).select("old", "new")

    # A line of an added unit counts marked and as it is, for the other's name may stand in it from the start.
    forms = F.when(F.col("side") == "old", F.col("lines")).otherwise(F.concat("lines", F.filter("plain", lambda x: ~F.array_contains("lines", x))))
    each = both.filter("size(lines) >= 3").select("side", "id", "kind", "language", F.size("lines").alias("n"), F.explode(forms).alias("line"))
    times = each.groupBy("side", "id", "kind", "language", "n", "line").agg(F.count(F.lit(1)).alias("times"))
    tokens = times.select("side", "id", "kind", "language", "n", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "times"), lambda k: F.xxhash64("line", k))).alias("token"))
    key = ["kind", "language", "token"]
    shared = tokens.groupBy(*key).agg(F.count(F.lit(1)).alias("holders"), F.count_distinct("side").alias("sides")).filter("sides = 2").drop("sides")
    placed = tokens.join(shared, key)
    place, all_ = Window.partitionBy("side", "id").orderBy("holders", "token"), Window.partitionBy("side", "id")
    placed = placed.withColumn("left", F.count(F.lit(1)).over(all_) - F.row_number().over(place) + 1)
    part = least / 2  # of the lines of both
    smallest = F.greatest(F.lit(3), F.ceil(F.col("n") * part / (1 - part)))
    placed = placed.filter(F.col("left") >= part * (F.col("n") + smallest) - 1e-6).withColumn("cell", F.floor(F.log("n") / math.log(CELL)))
    reach = math.ceil(math.log((1 - part) / part) / math.log(CELL)) + 1
    old = placed.filter("side = 'old'").select(*key, F.col("id").alias("old"), F.col("n").alias("o_n"), F.col("left").alias("o_left"), F.explode(F.sequence(F.col("cell") - reach, F.col("cell") + reach)).alias("cell"))
    new = placed.filter("side = 'new'").select(*key, F.col("id").alias("new"), F.col("n").alias("n_n"), F.col("left").alias("n_left"), "cell")
    near = old.join(new, [*key, "cell"]).filter((F.least("o_left", "n_left") >= part * (F.col("o_n") + F.col("n_n")) - 1e-6) & (F.col("o_n") <= 2 * F.col("n_n")) & (F.col("n_n") <= 2 * F.col("o_n")))
    pairs = near.select("old", "new").unionByName(equal).distinct()
    of = lambda c, source: both.filter(F.col("side") == c).select(F.col("id").alias(c), "kind", "language", F.col("name").alias(f"{c}_name"), F.col("source").alias(source))
    return pairs.join(of("old", "before"), "old").join(of("new", "after"), ["new", "kind", "language"]).select("kind", "language", "old", "old_name", "before", "new", "new_name", "after")


def apply_renames(changes: DataFrame, matches: DataFrame) -> DataFrame:
    """Changes with each matched pair as one: ``renamed``, or ``moved`` where the name is the same."""
    old = changes.join(matches, changes["id"] == matches["old"]).select(F.col("new").alias("m_new"), F.col("name").alias("old_name"), F.col("before_source").alias("old_source"), F.col("id").alias("old_id"))
    rest = changes.join(matches, changes["id"] == matches["old"], "left_anti")
    joined = rest.join(old, rest["id"] == old["m_new"], "left")
    hit = F.col("m_new").isNotNull()
    return joined.withColumn("status", F.when(hit, F.when(F.col("old_name") == F.col("name"), "moved").otherwise("renamed")).otherwise(F.col("status"))).withColumn("before_source", F.when(hit, F.col("old_source")).otherwise(F.col("before_source"))).withColumnRenamed("old_id", "before_id").drop("m_new", "old_name", "old_source")


def signals(changes: DataFrame, old_edges: DataFrame, new_edges: DataFrame, support: DataFrame, name: Callable[[str], Column] = F.col) -> DataFrame:
    """id, signal, n, related: what of a changed unit's surroundings did not change with it.

    changes: id, status. support: id of test support. ``n`` counts all, ``related``
    lists the first twelve by id. Added units have no callers that stayed as they
    were; removed ones are looked up in the old edges and have no test signal.
    ``name`` gives the id of a column, where all go by keys; id stays a key.
    """
    ids, tests = changes.select(F.col("id").alias("c")), support.select(F.col("id").alias("s"))
    live = changes.filter("status <> 'removed'")

    def callers(edges: DataFrame, of: DataFrame) -> DataFrame:
        calls = edges.filter("kind = 'calls'").join(of.select("id"), F.col("dst") == F.col("id"), "left_semi")
        calls = calls.join(ids, F.col("src") == F.col("c"), "left_anti").join(tests, F.col("src") == F.col("s"), "left_anti")
        return calls.select(F.col("dst").alias("id"), F.lit("unchanged-callers").alias("signal"), F.col("src").alias("other"))

    called = callers(new_edges, changes.filter("status = 'modified'")).unionByName(callers(old_edges, changes.filter("status = 'removed'")))
    subject = live.join(tests, F.col("id") == F.col("s"), "left_anti").select("id")
    tested = new_edges.filter("kind = 'tested-by'").join(subject, F.col("src") == F.col("id"), "left_semi")
    moved = tested.join(ids, F.col("dst") == F.col("c"), "left")
    seen = moved.select(F.col("src").alias("id"), F.when(F.col("c").isNotNull(), "tests-changed").otherwise("tests-unchanged").alias("signal"), F.col("dst").alias("other"))
    # One row for each relation counts; of the others only the first few, cut before they meet, are listed.
    pairs = called.unionByName(seen)
    counts = pairs.groupBy("id", "signal").agg(F.count(F.lit(1)).alias("n"))
    # Equal others share a rank, so they fall together where they are ranked.
    ranked = pairs.select("id", "signal", name("other").alias("other")).withColumn("place", F.dense_rank().over(Window.partitionBy("id", "signal").orderBy("other")))
    listed = ranked.filter(F.col("place") <= MAX_RELATED).groupBy("id", "signal").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("related"))
    some = counts.join(listed, ["id", "signal"])
    none = subject.join(tested.select(F.col("src").alias("t")), F.col("id") == F.col("t"), "left_anti").select("id", F.lit("no-known-test").alias("signal"), F.lit(0).cast("long").alias("n"), F.lit("").alias("related"))
    return some.unionByName(none)


def signal_counts(found: DataFrame) -> DataFrame:
    """signal, units, detail, phrase: how many changed units each signal holds for, and what it says of them."""
    n = found.groupBy("signal").agg(F.count(F.lit(1)).alias("units"))
    said = F.lit("have no test that calls them")
    for signal, words in PHRASES.items():
        said = F.when(F.col("signal") == signal, words).otherwise(said)
    return n.select("signal", "units", plural(F.col("units"), "changed unit").alias("detail"), said.alias("phrase"))


def change_stops(changes: DataFrame, most: int = MAX_STOPS) -> DataFrame:
    """The first changes by cohort, path, start and id, numbered."""
    return top_overall(changes, [F.col("cohort"), F.col("path"), F.col("start"), F.col("id")], most, "stop_no")


__all__ = [n for n in dir() if not n.startswith("_") and n != "union_all"]
