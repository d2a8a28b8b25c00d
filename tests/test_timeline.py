"""Joins along time and subtotals against plain loops."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from terrace.operators import rollups, timeline


def key(r):
    return tuple((x is not None, str(x)) for x in r)


@pytest.mark.parametrize("seed,users", [(1, 4), (2, 1), (3, 40)])
def test_as_of(spark, seed, users):
    """Ties, repeated rows, nulls, users without rows, and a user that holds all rows over many ranges."""
    r = random.Random(seed)
    left = [(r.randrange(users), r.randint(0, 300), n) for n in range(200)] + [(0, 5, 1)] * 3 + [(None, 5, 2), (0, None, 3), (99, 5, 4)]
    right = [(r.randrange(users), r.randint(0, 300) // 7 * 7, f"v{n}") for n in range(60)] + [(None, 1, "no"), (0, None, "no"), (98, 1, "no")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps many ranges
    try:
        got = timeline.as_of(df(left, "user long, ts int, n int"), df(right, "user long, since int, v string"), ["user"], "ts", "since", ["v"])
        assert got.columns == ["user", "ts", "n", "since", "v"]
        rows = sorted(map(tuple, got.collect()), key=key)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")

    def last(u, t):
        found = [(s, v) for w, s, v in right if u is not None and t is not None and w == u and s is not None and s <= t]
        return max(found) if found else (None, None)

    assert rows == sorted(((u, t, n, *last(u, t)) for u, t, n in left), key=key)


def test_as_of_empty_sides(spark):
    left, right = spark.createDataFrame([(1, 2)], "k int, t int"), spark.createDataFrame([(1, 1, "a")], "k int, s int, v string")
    assert [tuple(r) for r in timeline.as_of(left, right.limit(0), ["k"], "t", "s", ["v"]).collect()] == [(1, 2, None, None)]
    assert timeline.as_of(left.limit(0), right, ["k"], "t", "s", ["v"]).collect() == []


def test_within(spark):
    r, day = random.Random(5), datetime.datetime(2024, 1, 1)
    left = [(r.randrange(3), day + datetime.timedelta(seconds=r.randint(0, 900)), n) for n in range(60)]
    right = [(r.randrange(3), day + datetime.timedelta(seconds=r.randint(-100, 900)), n) for n in range(60)]
    got = timeline.within(spark.createDataFrame(left, "k int, t timestamp, a int"), spark.createDataFrame(right, "k int, s timestamp, b int"), ["k"], "t", "s", 60)
    want = [(a, b) for k, t, a in left for j, s, b in right if j == k and 0 <= (t - s).total_seconds() <= 60]
    assert sorted((x.a, x.b) for x in got.collect()) == sorted(want)


def test_subtotals_of_two_snapshots(spark):
    """Sketches of two snapshots unite without counting twice what both hold; null keys are not subtotals."""
    rows = [(f"c{n % 3}" if n % 5 else None, f"s{n % 2}", n % 700, 1) for n in range(3000)]
    df = spark.createDataFrame(rows, "cohort string, status string, path long, size long")
    keys = ["cohort", "status"]
    groups = rollups.sketched(df.filter("path < 400"), keys, "path", "size").unionByName(rollups.sketched(df.filter("path > 200"), keys, "path", "size"))
    both = {(x.cohort, x.status, x.depth): (x.n, x.amount, x.distinct) for x in rollups.rolled_up(groups, keys).collect()}
    for depth, pick in ((0, lambda r: (None, None)), (1, lambda r: (r[0], None)), (2, lambda r: (r[0], r[1]))):
        for group in {pick(r) for r in rows}:
            own = [r for r in rows if pick(r) == group]
            n, amount, distinct = both[(*group, depth)]
            assert n == amount == sum((r[2] < 400) + (r[2] > 200) for r in own)
            assert abs(distinct - len({r[2] for r in own})) <= 0.05 * len({r[2] for r in own})
    assert len(both) == 1 + 4 + 8


def test_one_key_and_empty_table(spark):
    none = spark.createDataFrame([], "a string, v long, x long")
    (row,) = rollups.rolled_up(rollups.sketched(none, ["a"], "v", "x"), ["a"]).filter(F.col("depth") == 0).collect() or [None]
    assert row is None or row.n in (None, 0)
