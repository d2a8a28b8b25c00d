"""The sweep over points and ranges against a plain search."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from terrace.operators import ranges as sweep


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_search(spark, monkeypatch, seed):
    """Nested, crossing, empty and null ranges, points on bounds, repeated and null ones, over several blocks."""
    monkeypatch.setattr(sweep, "SPAN", 16)
    r = random.Random(seed)
    spans = [(r.choice(["a", "b", "c"]), s := r.randint(-20, 80), s + r.randint(-2, 40), r.randint(0, 5), f"u{n}") for n in range(60)]
    spans += [(None, 0, 90, 0, "no"), ("a", None, 9, 0, "no"), ("a", 3, None, 0, "no")]
    points = [(r.choice(["a", "b", "d"]), r.randint(-30, 130), n, [n]) for n in range(200)] + [("a", None, 1, []), (None, 5, 2, None), ("a", 7, 3, [1]), ("a", 7, 3, [1])]
    got = sweep.first_range(spark.createDataFrame(points, "path string, line int, n int, more array<int>").repartition(3), spark.createDataFrame(spans, "path string, start int, end int, ord int, unit string"), ["path"])
    assert got.columns == ["path", "line", "n", "more", "unit"]

    def first(path, line):
        held = [(o, u) for p, s, e, o, u in spans if path is not None and line is not None and p == path and s is not None and e is not None and s <= line <= e]
        return min(held)[1] if held else None

    key = lambda row: tuple((x is not None, str(x)) for x in row)
    assert sorted((tuple(x) for x in got.collect()), key=key) == sorted(((p, at, n, m, first(p, at)) for p, at, n, m in points), key=key)


def test_two_keys_and_empty_sides(spark):
    points = spark.createDataFrame([("a", 1, 5), ("a", 2, 5)], "dir string, part int, line int")
    spans = spark.createDataFrame([("a", 2, 1, 9, 0, "u")], "dir string, part int, start int, end int, ord int, unit string")
    assert sorted(map(tuple, sweep.first_range(points, spans, ["dir", "part"]).collect())) == [("a", 1, 5, None), ("a", 2, 5, "u")]
    assert [r.unit for r in sweep.first_range(points, spans.limit(0), ["dir", "part"]).collect()] == [None, None]
    assert sweep.first_range(points.limit(0), spans, ["dir", "part"]).collect() == []


def test_one_large_file(spark):
    """100,000 lines and 10,000 nested ranges of one file: no join in the plan, and each line seen once."""
    lines = spark.range(100_000).select(F.lit("a").alias("path"), F.col("id").alias("line"))
    spans = spark.range(10_000).select(F.lit("a").alias("path"), (F.col("id") * 5).alias("start"), (100_000 - F.col("id") * 5).alias("end"), (-F.col("id")).alias("ord"), F.concat(F.lit("u"), "id").alias("unit"))
    got = sweep.first_range(lines, spans, ["path"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Nested" not in plan
    start = time.time()
    rows = {r.line: r.unit for r in got.collect()}
    assert len(rows) == 100_000 and time.time() - start < 60
    assert all(rows[n] == f"u{min(n // 5, (100_000 - n) // 5, 9999)}" for n in range(0, 100_000, 97))
