"""Components and levels of imports against a plain search."""

from __future__ import annotations

import random

import pytest

from terrace.functions import go_refs
from terrace.operators import packages
from tests.test_go_types import FILES


def plainly(nodes, edges):
    out = {n: {b for a, b in edges if a == n and b in nodes and b != n} for n in nodes}

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            for m in out[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        return seen

    far = {n: reach(n) for n in nodes}
    comp = {n: min(m for m in far[n] if n in far[m]) for n in nodes}
    level = {}

    def depth(c):
        if c not in level:
            level[c] = max((1 + depth(comp[m]) for n in nodes if comp[n] == c for m in out[n] if comp[m] != c), default=0)
        return level[c]

    return sorted((n, comp[n], depth(comp[n])) for n in nodes)


@pytest.mark.parametrize("seed,n,m", [(1, 14, 22), (2, 20, 24), (3, 12, 40)])
def test_rings_and_levels(spark, seed, n, m):
    """Rings within rings, loops, repeated edges, unknown nodes and nulls."""
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
    edges += edges[:2] + [(0, 0), (1, 99), (98, 1)]
    nodes = spark.createDataFrame([(i,) for i in [*range(n), 3, None]], "id long")
    got = packages.package_order(nodes, spark.createDataFrame([*edges, (None, 1)], "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == plainly(set(range(n)), edges)


def test_no_edges_and_no_nodes(spark):
    none = spark.createDataFrame([], "src string, dst string")
    assert packages.package_order(spark.createDataFrame([], "id string"), none).collect() == []
    assert [tuple(r) for r in packages.package_order(spark.createDataFrame([("a",)], "id string"), none).collect()] == [("a", "a", 0)]
    with pytest.raises(ValueError):
        packages.levels(spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"))


def test_packages_of_a_module(spark):
    files = spark.createDataFrame([*FILES.items(), ("main.go", 'package main\n\nimport "example.com/m/work"\n')], "path string, source string")
    got = packages.package_order(*packages.imports(go_refs.reference_table(files).cache(), "example.com/m"))
    assert sorted(map(tuple, got.collect())) == [(".", ".", 2), ("base", "base", 0), ("work", "work", 1)]
