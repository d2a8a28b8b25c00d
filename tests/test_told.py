"""Narration, payloads, answers, settings and caches on small rows of our own."""

import json

import pytest
from pyspark.sql import functions as F

from terrace import settings
from terrace.errors import EngineError, Kind
from terrace.operators import explain, narration, presentation
from terrace.settings import Settings


def said(df, *order):
    return [r.sentence for r in df.orderBy(*order).collect()]


def test_lists(spark):
    rows = spark.createDataFrame([(0, []), (1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"])], "n int, names array<string>")
    assert [r[0] for r in rows.orderBy("n").select(narration.listed(F.col("names"))).collect()] == ["", "a", "a and b", "a, b and c"]


def test_connections(spark):
    nodes = spark.createDataFrame([("u", "func main", ["entry point"], True), ("v", "method T.Run", [], True), ("t", "func TestRun", ["test"], True), ("f", "a.go", [], False)] + [(f"c{n}", f"func c{n}", [], True) for n in range(6)], "id string, name string, roles array<string>, is_unit boolean")
    edges = spark.createDataFrame([(f"c{n}", "v", "calls") for n in range(6)] + [("t", "v", "calls"), ("v", "t", "tested-by"), ("u", "gone", "calls"), ("f", "v", "contains")], "src string, dst string, kind string")
    found = narration.connections(nodes, edges)
    assert said(found.filter("id = 'v'"), "place") == ["6 callers: c0, c1, c2 and c3 and 2 more.", "Checked by TestRun."]
    assert said(found.filter("id = 'u'"), "place") == ["Relies on gone of this tree."]
    assert said(found.filter("id = 't'"), "place") == ["Relies on T.Run of this tree."]
    assert said(found.filter("id = 'c0'"), "place") == ["Relies on T.Run of this tree.", "No known caller."]
    assert narration.connections(nodes.limit(0), edges.limit(0)).count() == 0


def test_changes_and_signals(spark):
    columns = "status string, name string, path string, added int, removed int, old_name string, old_path string, whitespace_only boolean"
    rows = [("added", "func A", "p", 1, 0, None, None, False), ("removed", "func A", "p", 0, 2, None, None, False), ("renamed", "func B", "p", 1, 1, "func A", "p", False), ("moved", "func A", "q", 0, 0, "func A", "p", True), ("file context changed", "p", "p", 3, 1, None, None, False), ("modified", "func A", "p", 2, 1, None, None, None)]
    changes = spark.createDataFrame(rows, columns).coalesce(1)
    assert [r[0] for r in changes.select(narration.change_sentence(changes)).collect()] == [
        "New: A, 1 line.", "Gone: A, 2 lines.", "Renamed: A, now B; 1 line in, 1 out.", "Moved: A, p to q; 0 lines in, 0 out. Nothing but blanks differs.",
        "Around the units of p; 3 lines in, 1 out.", "Edited: A; 2 lines in, 1 out.",
    ]
    one = spark.createDataFrame([("unchanged-callers", "removed", ["a"]), ("tests-unchanged", "modified", ["a"]), ("tests-changed", "modified", ["a", "b"]), ("no-known-test", "added", [])], "k string, s string, n array<string>").coalesce(1)
    assert [r[0] for r in one.select(narration.signal_sentence(F.col("k"), F.col("s"), F.col("n"))).collect()] == ["Had been called, and still is in the text, from a.", "Tests left as they were: a.", "Tests changed too: a and b.", "No known test."]


def test_brief_narration(spark):
    facts = [("u", "test-states", 1, "does work", "test", "", "unit:a_test.go:func TestDo", ""), ("u", "uncommitted", 1, "x", "current", "", "", ""), *(("u", "commit", n, f"c{n}", "dated-history", f"2024-01-0{n}", "", "") for n in (1, 2, 3, 4)), ("u", "comment", 1, "old", "comment-older-than-code", "2023-01-01", "", "")]
    rows = spark.createDataFrame(facts, "node string, kind string, n int, text string, reliability string, date string, other string, source string")
    assert said(narration.narrate_brief(rows), "place") == [
        "TestDo, a test, claims “does work”.", "Edited since the last commit; what follows is of the committed text.", "Last commit here, 2024-01-01: “c1”.",
        "Earlier: 2024-01-02 “c2” and 2024-01-03 “c3”.", "A comment above, of 2023-01-01 and older than the code, perhaps stale: “old”",
    ]


def test_diff_text_and_rows(spark):
    hunk = [("-", "a", 3, 0), ("+", "b", 0, 4)]
    whole = spark.createDataFrame([(1, [hunk, hunk, hunk]), (2, [])], "id int, hunks array<array<struct<op: string, text: string, before: int, after: int>>>")
    cut = {r.id: (r.d.text, r.d.omitted) for r in whole.select("id", explain.diff_text(F.col("hunks"), 18).alias("d")).collect()}
    assert cut == {1: ("@@\n-a\n+b\n" * 2, 1), 2: ("", 0)}
    assert [(r.hunk_no, r.op, r.text) for r in presentation.review_rows(whole, "id").orderBy("hunk_no", "row_no").limit(3).collect()] == [(0, "", "@@ −3 +4 @@"), (0, "-", "a"), (0, "+", "b")]
    prompt = explain.change_prompt(F.lit("p"), F.lit("u"), F.lit("modified"), F.lit("x"), F.lit("y"), explain.diff_text(F.col("hunks"), 18), F.lit(None).cast("string"), "Ask.")
    assert {r.p for r in whole.select(prompt.alias("p")).collect()} == {"Ask.\nPath: p\nUnit: u\nStatus: modified\nBetween: x and y\nChanged lines (- before, + after):\n```\n" + "@@\n-a\n+b\n" * 2 + "```\n1 further hunk left out for want of room.\n", "Ask.\nPath: p\nUnit: u\nStatus: modified\nBetween: x and y\nNo line of source differs; relationships do, as told below.\n"}


def test_sending_and_cache(spark, tmp_path):
    rows = [("s", 1, 60, False, False, 40), ("s", 2, 60, False, True, 0), ("s", 3, 60, False, False, 0), ("s", 4, 1, False, False, 0), ("s", 5, 9, True, False, 0), (None, 1, 101, False, False, 0), (None, 2, None, False, None, None)]
    sent = explain.sending(spark.createDataFrame(rows, "session string, n int, estimate int, cached boolean, failed boolean, actual int"), 100)
    assert {(r.session, r.n): (r.status, r.used) for r in sent.collect()} == {("s", 1): ("sent", 40), ("s", 2): ("failed", 40), ("s", 3): ("sent", 100), ("s", 4): ("refused", 100), ("s", 5): ("cached", 100), (None, 1): ("refused", 0), (None, 2): ("sent", 0)}
    cache = str(tmp_path / "cache")
    for batch in ([("a", "1"), ("a", "2"), ("b", ""), ("c", "x" * (1 << 20) + "x")], [("a", "3"), ("d", "4")]):
        explain.cache_write(spark.createDataFrame(batch, "key string, text string"), cache)
    assert {(r.key, r.text) for r in spark.read.parquet(cache).collect()} == {("a", "1"), ("d", "4")}


@pytest.mark.parametrize("shape, good", [("responses", {"output": [{}, {"content": [{"type": "output_text", "text": "a"}, {"type": "other", "text": "no"}, {"type": "output_text", "text": "b"}]}], "usage": {"input_tokens": 3, "output_tokens": 2}}), ("chat", {"choices": [{"message": {"content": "a"}}, {"message": {"content": " \n"}}, {"message": {"content": "b"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}), ("messages", {"content": [{"type": "text", "text": "a"}, {"type": "tool"}, {"type": "text", "text": "b"}], "usage": {"input_tokens": 3, "output_tokens": 2}})])
def test_answers(spark, shape, good):
    raw = spark.createDataFrame([(1, json.dumps(good)), (2, json.dumps({"error": {"message": "m" * 300}})), (3, "no json"), (4, None)], "id int, json string")
    assert {r.id: (r.text, r.input_tokens, r.output_tokens, r.error) for r in explain.answers(raw, shape).collect()} == {1: ("a\nb", 3, 2, None), 2: (None, 0, 0, "m" * 240), 3: (None, 0, 0, "the answer holds no text"), 4: (None, 0, 0, "the answer holds no text")}


def test_marks(spark):
    marks = spark.createDataFrame([("r", f"i{n % 3}", n) for n in range(9)], "tree string, id string, ts int")
    assert [r.id for r in presentation.kept_marks(marks, ["tree"], [F.col("ts").desc()], 2).orderBy("back").collect()] == ["i2", "i1"]


def test_settings(tmp_path):
    path = tmp_path / "config.json"
    assert settings.load(str(path)) == Settings()
    path.write_text('{"provider": "openai-compatible", "endpoint": "https://example.com/v1", "model": "m", "other": 1, "max_input_tokens": 500}')
    s = settings.load(str(path))
    assert (s.destination(), s.target(), s.max_input_tokens) == ("example.com", "openai-compatible https://example.com/v1", 500)
    assert Settings(provider="openai").destination() == "api.openai.com" and Settings(provider="openai-compatible", endpoint="http://127.0.0.1:1/x").checked()
    for bad in ("[1]", "{", '{"max_input_tokens": 1}', '{"provider": "x"}', '{"endpoint": "https://a"}', '{"max_input_tokens": "9"}', *(json.dumps({"provider": "openai-compatible", "endpoint": "https://a/b"} | x) for x in ({"endpoint": "http://a/b"}, {"endpoint": "https://u@a"}, {"endpoint": "https://a#f"}, {"api": "x"}, {"auth": "x"}, {"api_key_env": "a-b"}))):
        path.write_text(bad)
        with pytest.raises(EngineError) as e:
            settings.load(str(path))
        assert e.value.kind is Kind.INVALID
