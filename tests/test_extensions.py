"""Strict JSON, a table function called from SQL, and streams against batch."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.errors import AnalysisException

from terrace.functions import strict_json, table_functions
from terrace.streaming import sessions


def test_strict_json(spark):
    rows = {
        '{"id": 1, "name": "a", "on": true, "score": 2}': None, '{"id": 1}': None, '{"id": 1, "name": null}': None, '{"id": 1, "score": 2.5}': None, '{"id": 1, "score": -3e2}': None,
        '{"id": "1"}': "id is no bigint", '{"id": 1.5}': "id is no bigint", '{"id": 1, "name": 2}': "name is no string", '{"id": 1, "on": "true"}': "on is no boolean", '{"id": 1, "score": [1]}': "score is no double", '{"id": {"id": 1}}': "id is no bigint",
        '{"id": 1, "Id": 2}': "unknown key Id", '{"id": 1, "zz": 1, "b": {"c": 1}}': "unknown key b", '{"name": "a"}': "id is missing", '{"id": null}': "id is missing", "{}": "id is missing",
        "[1]": "no object", "1": "no object", '"id"': "no object", "null": "no object", '{"id": 1': "no JSON", "": "no JSON", None: "no JSON", "nonsense": "no JSON",
    }
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = strict_json.strictly(df, "t", {"id": "bigint", "name": "string", "on": "boolean", "score": "double"}, ("id",)).collect()
    assert {r.t: r.reason for r in got} == rows
    assert all((r.value is None) == (r.reason is not None) for r in got)
    value = {r.t: r.value for r in got}['{"id": 1, "name": "a", "on": true, "score": 2}']
    assert tuple(value) == (1, "a", True, 2.0)


def test_runs(spark):
    table_functions.register(spark)
    r = random.Random(3)
    rows = [(k, n, r.choice(["a", "b", None]), n * 10) for k in ("x", "y", None) for n in range(40)]
    spark.createDataFrame(rows, "k string, n int, v string, w long").repartition(3).createOrReplaceTempView("told")
    got = spark.sql("SELECT * FROM runs(TABLE(told) PARTITION BY k ORDER BY (n), 'v', 'k', 'w')")
    assert [f.simpleString() for f in got.schema.fields] == ["run:bigint", "value:string", "rows:bigint", "first_k:string", "first_w:bigint"]
    want = []
    for key in ("x", "y", None):
        own, run = [x for x in rows if x[0] == key], 0
        for n, x in enumerate(own):
            if n == 0 or x[2] != own[n - 1][2]:
                run += 1
                want.append([run, x[2], 0, key, x[3]])
            want[-1][2] += 1
    order = lambda x: (str(x[3]), x[0])
    assert sorted((list(x) for x in got.collect()), key=order) == sorted(want, key=order)
    assert spark.sql("SELECT * FROM runs(TABLE(SELECT * FROM told WHERE false) PARTITION BY k ORDER BY (n), 'v')").collect() == []
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM runs(TABLE(told) PARTITION BY k ORDER BY (n), 'gone')").collect()


def at(minutes: float) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def streamed(spark, tmp_path, name, batches, schema):
    """A stream of these batches, one file each, in order."""
    folder = str(tmp_path / name)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part={n:02}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run(spark, stream, tmp_path, name):
    out = str(tmp_path / f"{name}-out")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.read.parquet(out)


def test_sessions_of_a_stream(spark, tmp_path):
    """Rows out of order join their session; one beyond the watermark is left out; the rest is as in batch."""
    first = [("a", at(0)), ("a", at(40)), ("b", at(5)), (None, at(1))]
    second = [("a", at(20)), ("b", at(90)), ("a", at(200))]
    late, last = [("b", at(3))], [("z", at(2000))]
    found = run(spark, sessions.sessions(streamed(spark, tmp_path, "events", [first, second, last, late, [("z", at(4000))]], "u string, ts timestamp"), "u", "ts"), tmp_path, "sessions")
    batch = sessions.sessions(spark.createDataFrame(first + second, "u string, ts timestamp"), "u", "ts")
    rows = lambda df: sorted(map(tuple, df.filter("u <> 'z'").collect()))
    assert rows(found) == rows(batch) and ("a", at(0), at(70), 3) in rows(batch)


def test_pairs_of_two_streams(spark, tmp_path):
    r = random.Random(4)
    asks = [[(r.choice("ab"), at(60 * n + r.randint(0, 59)), f"q{n}-{k}") for k in range(6)] for n in range(4)]
    answers = [[(r.choice("ab"), at(60 * n + r.randint(0, 59)), f"r{n}-{k}") for k in range(6)] for n in range(4)]
    kinds = "u string, ts timestamp, q string", "u string, after timestamp, r string"
    left, right = (streamed(spark, tmp_path, name, batches, kind) for name, batches, kind in (("asks", asks, kinds[0]), ("answers", answers, kinds[1])))
    found = run(spark, sessions.followed(left, right, "u", "ts", "after", late="3 hours"), tmp_path, "pairs")
    whole = sessions.followed(spark.createDataFrame(sum(asks, []), kinds[0]), spark.createDataFrame(sum(answers, []), kinds[1]), "u", "ts", "after")
    want = {(q, x) for u, t, q in sum(asks, []) for v, s, x in sum(answers, []) if u == v and t <= s <= t + datetime.timedelta(hours=1)}
    pairs = lambda df: {(x.q, x.r) for x in df.collect()}
    assert pairs(whole) == want == pairs(found)
