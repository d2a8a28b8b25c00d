"""What the graph's queries shuffle."""

from __future__ import annotations

import re

from terrace.operators import evidence, graph, narration, navigation, review
from terrace.plans import tables


def shuffled(df):
    """The keys of each exchange of a plan; those of long numbers end in L."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+#\d+L?)", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*?)\), ", plan)]


def test_edges_are_shuffled_by_numbers(spark, sf_dir):
    keys = shuffled(tables.edges_of(spark, sf_dir, True))
    assert keys and all(key.endswith("L") for of in keys for key in of)


def test_read_next_shuffles_pairs_twice(spark):
    """By target to meet its score, by id to be ranked; pairs that are near in two ways fall together on the way."""
    pairs = [("a", "b", "calls", 0), ("a", "b", "contains", 0), ("b", "a", "tested-by", 0), ("a", "c", "imports", 0), ("c", "a", "calls", 0)]
    edges = spark.createDataFrame(pairs, "src string, dst string, kind string, ord int").repartition(3)
    nodes = spark.createDataFrame([("a", 5), ("b", 7), ("c", 9)], "id string, score long").repartition(3)
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = graph.read_next(nodes, edges)
        assert len(shuffled(near)) == 3  # pairs by target, nodes by id, pairs by id
        got = sorted((r.id, r["rank"], r.target, r.relationship, r.score) for r in near.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    assert got == [("a", 1, "b", "calls", 7), ("a", 2, "c", "imports", 9), ("b", 1, "a", "tested-by", 5), ("c", 1, "a", "calls", 5)]


def test_nodes_meet_their_edges_by_numbers(spark, sf_dir):
    for df in (tables.nodes_of(spark, sf_dir), tables.orientation(spark, sf_dir)):
        keys = shuffled(df)
        assert keys and all(key.endswith("L") for of in keys for key in of)


def without_broadcasts(spark, make):
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = make()
        return shuffled(df), df.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)


def test_each_relation_of_a_brief_is_shuffled_once(spark):
    """Equal others and callers that are tests fall out where they are ranked; the limits still count distinct others."""
    pairs = [("a", "b", "calls"), ("a", "b", "local-module-source"), *(("a", f"t{n}", "tested-by") for n in range(6)), *((f"t{n}", "a", "calls") for n in range(6)), *((f"x{n}", "a", "calls") for n in range(12))]
    edges = spark.createDataFrame(pairs, "src string, dst string, kind string").repartition(3)
    nodes = spark.createDataFrame([("a", ["test"])], "id string, roles array<string>").repartition(2)
    keys, rows = without_broadcasts(spark, lambda: evidence.relation_facts(nodes, edges))
    assert len(keys) <= 4  # calls, tests and callers; the tests perhaps once more, beside the callers
    got = sorted((r.kind, r.n, r.other) for r in rows if r.node == "a")
    callers = ["t4", "t5", "x0", "x1", "x10", "x11", "x2", "x3"]
    assert got == [*(("called-by", n, o) for n, o in enumerate(callers, 1)), ("calls", 1, "b"), ("role", 1, "test"), *(("tested-by", n + 1, f"t{n}") for n in range(4))]


def test_a_brief_without_room_keeps_its_node(spark):
    facts = spark.createDataFrame([("a", "role", 1, "x" * 50, 1), ("b", "role", 1, "y", 1)], "node string, kind string, n int, other string, place int").repartition("node")
    keys, rows = without_broadcasts(spark, lambda: evidence.brief_text(facts, 40))
    assert len(keys) == 1
    assert sorted(map(tuple, rows)) == [("a", "[]"), ("b", '[{"kind":"role","other":"y"}]')]


def test_pairs_of_a_unit_and_its_callers_meet_once(spark):
    pairs = [("t", "a", "calls"), ("a", "t", "tested-by"), ("b", "a", "calls"), ("a", "b", "calls")]
    edges = spark.createDataFrame(pairs, "src string, dst string, kind string").repartition(3)
    nodes = spark.createDataFrame([("a", "func a", [], True), ("b", "func b", [], True), ("t", "func t", ["test"], True)], "id string, name string, roles array<string>, is_unit boolean").repartition(3)
    keys, rows = without_broadcasts(spark, lambda: narration.connections(nodes, edges))
    assert sum(len(of) == 2 for of in keys) <= 7  # by pair, and by unit and place
    assert sorted(map(tuple, rows)) == [("a", 0, "Relies on b of this tree."), ("a", 1, "One caller: b."), ("a", 2, "Checked by t."), ("b", 0, "Relies on a of this tree."), ("b", 1, "One caller: a."), ("t", 0, "Relies on a of this tree.")]


def test_a_testing_tour_meets_the_edges_of_its_first_units(spark):
    edges = spark.createDataFrame([(f"u{n:02}", f"t{n % 3}", "tested-by") for n in range(40)], "src string, dst string, kind string").repartition(3)
    ids = [*(f"u{n:02}" for n in range(40)), "t0", "t1", "t2"]
    nodes = spark.createDataFrame([(i, f"p{i}", n, n % 7, True, "go", []) for n, i in enumerate(ids)], "id string, path string, start int, score int, is_unit boolean, language string, roles array<string>").repartition(3)
    tour = navigation.testing(nodes, edges)
    assert "Limit" in tour._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]
    place = {r.id: (-r.score, r.path) for r in nodes.collect()}
    best: dict[str, tuple] = {}
    for e in edges.collect():
        for n, i in ((0, e.src), (1, e.dst)):
            best[i] = min(best.get(i, (("z",),)), ((place[e.src], e.dst, n),)) if i in best else ((place[e.src], e.dst, n),)
    want = sorted(best, key=best.get)[:16]
    assert [r.id for r in sorted(tour.collect(), key=lambda r: r.stop_no)] == want


def test_related_of_a_signal_are_ranked_without_a_shuffle_of_their_own(spark):
    edges = spark.createDataFrame([(f"c{n:02}", "a", "calls") for n in range(14)] * 2, "src string, dst string, kind string").repartition(3)
    changes = spark.createDataFrame([("a", "modified")], "id string, status string").repartition(2)
    none = spark.createDataFrame([], "id string")
    keys, rows = without_broadcasts(spark, lambda: review.signals(changes, edges, edges, none))
    assert not any(len(of) == 3 for of in keys)
    assert [(r.n, r.related) for r in rows if r.signal == "unchanged-callers"] == [(28, ",".join(f"c{n:02}" for n in range(12)))]


def test_sentences_of_relations_are_sorted_once_to_cut_and_gather(spark):
    """Ten relations of two kinds, two named each; names are gathered by a window in the order of the cut, not by an aggregate with a sort of its own."""
    delta = spark.createDataFrame([("a", "calls" if n % 2 else "imports", f"unit:x:func f{n}", "added") for n in range(10)], "src string, kind string, dst string, change string").repartition(3)
    none = spark.createDataFrame([], "id string")
    told = narration.relation_sentences(delta, none, 2)
    assert "ObjectHashAggregate" not in told._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.kind, r.sentence) for r in told.collect()) == [("calls", "Newly: calls f1 and f3 and 3 more."), ("imports", "Newly: imports f0 and f2 and 3 more.")]


def test_a_tour_writes_edges_only_where_it_goes_along_them(spark, sf_dir, monkeypatch):
    """Entry points enough for all stops end the walk, and its edges are read once."""
    tags = []
    real = tables.stage
    monkeypatch.setattr(tables, "stage", lambda df, tag, *a: tags.append((tag, len(df.columns))) or real(df, tag, *a))
    starts = tables.raw_roles(spark, sf_dir).filter("role = 'entry point'").select("id").distinct().count()
    for most, edges in ((starts, False), (starts + 1, True)):
        tags.clear()
        nodes, _ = tables.tour_graph(spark, sf_dir, most)
        assert [t for t, _ in tags] == ["edges"] * edges + ["scored"] and tags[-1][1] == 7
        assert {"name", "reasons"}.isdisjoint(nodes.columns)
