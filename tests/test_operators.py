"""Operators on small tables, and every query against its SQL."""

import os

import pytest
from pyspark.sql import functions as F

from terrace.errors import EngineError, Kind
from terrace.functions import text
from terrace.operators import evidence, navigation, presentation, review, scan
from terrace.operators.relational import first_wins, greedy_prefix, islands
from terrace.plans import catalogue


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.split_words(F.lit("parseHTTPRequest_v2Name"))) == "parse http request v2 name"
    assert one(spark, text.replace_identifier(F.lit("a.run run_ $run"), "run", "g$o\\")) == "a.g$o\\ run_ $g$o\\"
    assert one(spark, text.display_text(F.lit("a\tb\x07c  d​" + "e" * 9), 8)) == "a bc de…"
    assert one(spark, text.whitespace_only(F.lit("a  b "), F.lit("a\nb")))
    assert one(spark, F.to_json(F.array(text.count_lines(F.lit("a\n\n")), text.token_estimate(F.lit("éé"))))) == "[3,2]"
    assert one(spark, text.path_prefixes(F.lit("a/b/c"))) == ["a", "a/b", "a/b/c"] and one(spark, text.dirname(F.lit("x"))) == "."
    assert one(spark, text.short_name(F.lit("method T.Run "))) == "Run"


def test_relational(spark):
    rows = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 5)], "k int, v string, ord int")
    assert {(r.k, r.v) for r in first_wins(rows, ["k"], ["ord"]).collect()} == {(1, "b"), (2, "c")}
    seq = spark.createDataFrame([(n, v) for n, v in enumerate("aabbba")] + [(6, None), (7, None)], "n int, v string").withColumn("k", F.lit(1))
    assert [r.i for r in islands(seq, ["k"], [F.col("n")], F.col("v"), "i").orderBy("n").collect()] == [1, 1, 2, 2, 2, 3, 4, 4]
    sizes = spark.createDataFrame([(1, 40), (2, 50), (3, 20), (4, 5)], "n int, size int").withColumn("k", F.lit(1))
    assert [r.n for r in greedy_prefix(sizes, ["k"], [F.col("n")], F.col("size"), 100).collect()] == [1, 2]


def test_scan(spark):
    paths = ["a.py", ".git/x", "src/vendor/y", "a.tfvars", "b.tfstate.backup", ".env", ".env.local", ".envoy", "x/config.json", "vendor"]
    df = spark.createDataFrame([(p, "x") for p in paths], "path string, source string")
    kept = {r.path for r in scan.scan_bounded(df).collect()}
    assert kept == {p for p in paths if not any(scan.excluded_name(x, True) for x in p.split("/")[:-1]) and not scan.excluded_name(p.split("/")[-1], False)} == {"a.py", ".envoy", "vendor"}
    with pytest.raises(EngineError) as e:
        scan.check_limits(df, most_files=3)
    assert e.value.kind is Kind.TOO_LARGE
    one, two = (spark.createDataFrame(x, "path string, digest string") for x in ([("a", "1")], [("a", "2")]))
    with pytest.raises(EngineError) as e:
        scan.check_policy(one, two)
    assert e.value.kind is Kind.STALE
    scan.check_policy(one, one)


NODES = "id string, name string, path string, language string, start long, is_unit boolean, roles array<string>, score long"


def test_breadth_first(spark):
    nodes = spark.createDataFrame([(c, c, "p", "document" if c == "d" else "go", 1, c != "f", [], 0) for c in "abcdefg"], NODES)
    steps = spark.createDataFrame([("a", "f", 1), ("a", "b", 2), ("f", "g", 1), ("b", "d", 1), ("d", "a", 1), ("d", "e", 2), ("b", "g", 2)], "id string, target string, rank int")
    got = navigation.breadth_first(spark.createDataFrame([("a", 1), ("c", 2)], "id string, rank int"), steps, nodes).collect()
    assert [(r.stop_no, r.id, r.depth) for r in got] == [(1, "a", 0), (2, "c", 0), (3, "b", 1), (4, "g", 2), (5, "e", 3)]
    assert navigation.breadth_first(spark.createDataFrame([("a", 1)], "id string, rank int"), steps, nodes, 2).count() == 2


def test_breadth_first_walks_through_any_number_of_nodes_that_are_no_stops(spark):
    """A level of files alone is not cut, and its order decides that of the stops behind it."""
    nodes = spark.createDataFrame([("s", "s", "p", "go", 1, True, [], 0), ("t", "t", "p", "go", 1, True, [], 0)] + [(f"f{n}", "f", "p", "go", 1, False, [], 0) for n in range(60)] + [(f"u{n}", "u", "p", "go", 1, True, [], 0) for n in range(60)], NODES)
    steps = [("s", f"f{n}", n + 1) for n in range(60)] + [(f"f{n}", f"u{59 - n}", 1) for n in range(60)] + [("t", "u30", 1)]
    got = navigation.breadth_first(spark.createDataFrame([("s", 1), ("t", 2)], "id string, rank int"), spark.createDataFrame(steps, "id string, target string, rank int"), nodes).collect()
    assert [r.id for r in got] == ["s", "t", "u30"] + [f"u{59 - n}" for n in range(13)]


def test_testing_tour_when_pairs_share_tests(spark):
    """Forty units share a test; the stops are units in order of rank, the test after the first of them."""
    nodes = spark.createDataFrame([(f"u{n:02}", "u", "p", "go", n, True, [], 100 - n) for n in range(40)] + [("test", "t", "q", "go", 1, True, ["test"], 0), ("far", "t", "q", "go", 2, True, ["test"], 0)], NODES)
    edges = spark.createDataFrame([(f"u{n:02}", "test", "tested-by", 0) for n in range(40)] + [("u39", "far", "tested-by", 0)], "src string, dst string, kind string, ord int")
    got = navigation.testing(nodes, edges).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.stop_no)] == ["u00", "test", *(f"u{n:02}" for n in range(1, 15))]


def test_ranks_are_gapless_over_ranges(spark):
    nodes = spark.createDataFrame([(f"n{n}", "n", f"p{n % 3}", "go", n % 5, True, [], n % 7) for n in range(200)], NODES).repartition(6)
    want = [r.id for r in sorted(nodes.collect(), key=lambda r: (-r.score, r.path, r.start, r.id))]
    assert [r.id for r in sorted(navigation.ranks(nodes).collect(), key=lambda r: r.rank)] == want
    assert {r.rank for r in navigation.ranks(nodes).collect()} == set(range(1, 201))


def test_equal_edges_fall_together_between_known_nodes(spark):
    from terrace.operators import graph

    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = [("a", "b", "calls", 2), ("a", "b", "calls", 1), ("a", "x", "calls", 0), ("x", "b", "calls", 0), ("a", "b", "imports", 5)]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string, ord int")
    assert sorted(map(tuple, graph.add_edges(edges, nodes).collect())) == [("a", "b", "calls", 1), ("a", "b", "imports", 5)]
    named = spark.createDataFrame([(*r, f"line {r[3]}") for r in rows], "src string, dst string, kind string, ord int, provenance string")
    assert sorted((r.kind, r.provenance) for r in graph.add_edges(named, nodes).collect()) == [("calls", "line 1"), ("imports", "line 5")]


def test_renames(spark):
    schema = "id string, status string, kind string, language string, name string, before_source string, after_source string"
    body = "x {{\n one\n two\n three\n}}"
    rows = [("o1", "removed", "f", "go", "func a", body.replace("x", "a"), None), ("n1", "added", "f", "go", "func b", None, body.replace("x", "b")), ("o2", "removed", "f", "go", "func t", "t\n1\n2", None), ("n2", "added", "f", "go", "func u", None, "u\n1\n2"), ("n3", "added", "f", "go", "func v", None, "v\n1\n2"), ("o4", "removed", "t", "go", "type m", "m\n8\n9", None), ("n4", "added", "t", "go", "type m", None, "m\n8\n9")]
    changes = spark.createDataFrame(rows, schema)
    from terrace.functions import diff

    matches = review.mutual_best(diff.score_table(review.rename_candidates(changes)))
    got = {r.id: (r.status, r.before_id) for r in review.apply_renames(changes, matches).collect()}
    assert got == {"n1": ("renamed", "o1"), "n4": ("moved", "o4"), "o2": ("removed", None), "n2": ("added", None), "n3": ("added", None)}


def test_signals(spark):
    edges = spark.createDataFrame([("caller", "f", "calls"), ("t1", "f", "calls"), ("f", "t1", "tested-by"), ("f", "t2", "tested-by"), ("caller", "gone", "calls")], "src string, dst string, kind string")
    changes = spark.createDataFrame([("f", "modified"), ("t1", "modified"), ("gone", "removed"), ("new", "added")], "id string, status string")
    support = spark.createDataFrame([("t1",), ("t2",)], "id string")
    got = {(r.id, r.signal, r.n, r.related) for r in review.signals(changes, edges, edges, support).collect()}
    assert got == {("f", "unchanged-callers", 1, "caller"), ("f", "tests-changed", 1, "t1"), ("f", "tests-unchanged", 1, "t2"), ("gone", "unchanged-callers", 1, "caller"), ("new", "no-known-test", 0, "")}


def test_comments(spark):
    lines = ["#!/bin/sh", "# not: a shebang ends it", "", "// one", "// nolint", "//  two", "func f() {}", "x", "y"]
    df = spark.createDataFrame([("p", n, t) for n, t in enumerate(lines, 1)], "path string, line int, text string")
    units = spark.createDataFrame([("f", "p", 7), ("y", "p", 9), ("b", "p", 3)], "unit string, path string, start int")
    got = {r.unit: (r.n_lines, r.text) for r in evidence.leading_comments(df, units).collect()}
    assert got == {"f": (2, "one two"), "b": (1, "not: a shebang ends it")}


def test_budget_refunds(spark):
    rows = spark.createDataFrame([(1, 1, 200, False), (1, 2, 100, False), (1, 3, 100, True), (1, 4, 50, False)], "s int, n int, cost int, cached boolean")
    got = [(r.admitted, r.used) for r in presentation.budget_admission(rows, ["s"], 250).orderBy("n").collect()]
    assert got == [(True, 200), (False, 200), (True, 200), (True, 250)]


def test_streaming(spark, sf_dir, tmp_path):
    from terrace.streaming import refresh

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path / "in")
    events.coalesce(1).write.parquet(folder)
    stream = refresh.change_counts(spark.readStream.schema(events.schema).parquet(folder))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.d, r.event_type): r.n for r in events.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(r.start.date(), r.event_type): r.changes for r in spark.table("counts").collect()} == want


def value(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return "~" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = want.fetchall()
    assert sorted(tuple(value(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("least", [0.3, 0.5])
def test_line_matches_count_every_line(spark, least):
    """Also lines that more than twenty documents hold, against brute force."""
    import random

    rng = random.Random(6)
    hot = [f"hot {n}" for n in range(8)]
    rows = [(n, "\n".join(rng.sample(hot, rng.randint(0, 6)) + [f"rare {rng.randrange(60)}" for _ in range(rng.randint(0, 4))])) for n in range(120)]
    rows += [(n, "\n".join(hot)) for n in range(200, 260)] + [(301, "\n".join([*hot, "p", "q"])), (302, "\n".join([*hot, "p", "r"])), (400, "z"), (401, "z"), (402, None)]
    rows += [(n, "\n".join(f"fifty {m}" for m in range(50))) for n in range(501, 545, 2)] + [(n, "\n".join([f"fifty {m}" for m in range(50)] + [f"own {n}"])) for n in range(600, 602)]
    sets = {i: set(t.split("\n")) for i, t in rows if t is not None}
    score = {(a, b): round(2.0 * len(sets[a] & sets[b]) / (len(sets[a]) + len(sets[b])), 6) for a in sets for b in sets if a % 2 == 0 and b % 2}
    top = lambda pair: (score[pair] >= least and all(score[o] < score[pair] for o in score if o != pair and (o[0] == pair[0] or o[1] == pair[1])))
    want = {(*pair, score[pair]) for pair in score if top(pair)}
    got = [tuple(r) for r in catalogue.line_matches(spark.createDataFrame(rows, "doc_id long, source string"), least).collect()]
    assert (302, 301, 0.9) in want and sorted(got) == sorted(want)


def test_line_matches_meet_few_of_many_alike(spark, monkeypatch):
    """Short documents that share one common line: pairs that are compared grow with the documents, not with their square."""
    written, kept = {}, catalogue.stage

    def stage(df, tag, *more):
        written[tag] = kept(df, tag, *more)
        return written[tag]

    monkeypatch.setattr(catalogue, "stage", stage)
    rows = [(n, f"common\nmark {n // 2 % 150}\nown {n}") for n in range(600)] + [(901, "common"), (902, "common\nelse")]
    got = [tuple(r) for r in catalogue.line_matches(spark.createDataFrame(rows, "doc_id long, source string"), 0.3).collect()]
    assert got == [(902, 901, 0.666667)]
    assert written["scores"].count() <= 3000
    again = [(0, "a\nb"), (0, "a\nb"), (1, "a\nb"), (3, None)]
    assert [tuple(r) for r in catalogue.line_matches(spark.createDataFrame(again, "doc_id long, source string"), 0.3).collect()] == [(0, 1, 1.0)]
