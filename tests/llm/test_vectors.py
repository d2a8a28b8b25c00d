"""Searches over vectors against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from terrace.llm import ann, negatives, vectors
from terrace.llm.queries import op12_hard_negatives, op13_nearest

SCHEMA = "vec_id long, embedding array<double>, label int, kind string, n int"


def usable(vec):
    return bool(vec) and all(x is not None and math.isfinite(x) for x in vec)


def odd_rows(seed, n=160, dim=3, spread=2):
    """Many ties, copies of rows and of vectors, repeated ids, and rows that take no part."""
    r = random.Random(seed)
    rows = [(i, [float(r.randint(-spread, spread)) for _ in range(dim)], r.randint(0, 3), "x", 1) for i in range(n)]
    rows += [(r.randint(0, n), list(rows[r.randrange(n)][1]), r.randint(0, 3), "x", 1) for _ in range(n // 4)]
    rows += [rows[r.randrange(n)] for _ in range(n // 8)]
    rows += [(1000 + 20 * i, [1.0] * dim, 1, "hot", 1) for i in range(60)]
    rows += [(20, None, 1, "x", 1), (40, [], 1, "x", 1), (60, [1.0, None, 0.0], 1, "x", 1), (80, [float("nan"), 1.0, 0.0], 1, "x", 1), (100, [float("inf"), 1.0, 0.0], 2, "x", 1), (None, [1.0, 1.0, 1.0], 1, "x", 1), (120, [0.0] * dim, 1, "x", 1), (140, [1.0, 2.0], 2, "x", 1), (160, [1.0] * dim, None, "x", 1)]
    r.shuffle(rows)
    return rows


def key(r):
    return tuple((x is not None, x) for x in r)


def brute_nearest(rows, asks, k, dim=3):
    part = lambda r: r[0] is not None and usable(r[1]) and any(r[1]) and len(r[1]) == dim
    own = [r for r in rows if part(r)]
    out = []
    for n, q in enumerate(own):
        if asks(q[0]):
            best = sorted((-math.fsum(a * b for a, b in zip(q[1], c[1])), c[0]) for m, c in enumerate(own) if m != n)[:k]
            out += [(q[0], rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    """Shards, blocks and pages of a few rows each, so that all steps have work."""
    for name, n in (("SHARD_ROWS", 40), ("BLOCK_ROWS", 8), ("PAGE_SHARDS", 3), ("COPIES", 10)):
        monkeypatch.setattr(vectors, name, n)


@pytest.mark.parametrize("seed", [1, 2])
def test_factor_one_is_exact(spark, small, seed):
    rows = odd_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), 5, factor=1.0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute_nearest(rows, lambda i: i % 20 == 0, 5)


def test_fewer_candidates_than_asked_for(spark):
    rows = [(20 * n, [1.0, float(n), 0.5], 1, "x", 1) for n in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, ann.nearest(df, df, 20).collect())) == brute_nearest(rows, lambda i: True, 20)


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ann.nearest(df, df, 3).collect() == []
    assert negatives.hard_negatives(df, df).collect() == []
    some = spark.createDataFrame([(1, [1.0], 1, "x", 1)], SCHEMA)
    assert ann.nearest(some, some.limit(0), 3).collect() == []
    assert ann.nearest(some, some, 3).collect() == []
    assert negatives.hard_negatives(some, some).collect() == []


def recall(got, ids, x, k):
    at = {int(i): n for n, i in enumerate(ids)}
    found = {}
    for q, rank, i, score in got:
        assert score == pytest.approx(float(x[at[q]] @ x[at[i]]), abs=1e-12)
        found.setdefault(q, []).append((rank, -score, i))
    hits = 0
    for q, list_ in found.items():
        list_.sort()
        assert [r for r, _, _ in list_] == list(range(1, len(list_) + 1)) and [s for _, s, _ in list_] == sorted(s for _, s, _ in list_)
        scores = x @ x[at[q]]
        scores[at[q]] = -np.inf
        hits += len({int(ids[n]) for n in np.argsort(-scores)[:k]} & {i for _, _, i in list_})
    return hits / (k * len(found))


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_of_the_default_factor(spark, monkeypatch, clustered):
    """Vectors of all norms, in no order and in clusters."""
    monkeypatch.setattr(vectors, "SHARD_ROWS", 300)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 48))
    if clustered:
        x = rng.normal(size=(12, 48))[rng.integers(0, 12, 3000)] + 0.4 * x
    x *= rng.uniform(0.5, 2, (3000, 1))
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall(ann.nearest(df, df.filter("vec_id % 20 = 0"), 20).collect(), np.arange(3000), x, 20) >= 0.9


def test_nearest_query(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    got = op13_nearest(spark, sf_dir).collect()
    assert len(got) == 20 * (own.vec_id % 20 == 0).sum()
    assert recall(got, own.vec_id.to_numpy(), np.stack(own.embedding).astype(float), 20) >= 0.9


def brute_negatives(rows, asks, positives, negatives, low, high, scale, dim=3):
    own = [(r[0], [math.floor(scale * x) for x in r[1]], r[2]) for r in rows if r[0] is not None and r[2] is not None and usable(r[1]) and len(r[1]) == dim]
    out = []
    for n, a in enumerate(own):
        if not asks(a[0]):
            continue
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a[1], c[1])))), c[0], c[2]) for m, c in enumerate(own) if m != n)
        for p in [s for s in scored if s[2] == a[2]][:positives]:
            hard = [s for s in scored if s[2] != a[2] and low * -p[0] <= 100 * -s[0] <= high * -p[0]][:negatives]
            out += [(a[0], p[1], rank, s[1], -p[0], -s[0]) for rank, s in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,scale,low", [(3, 256, 80), (4, 1, 50), (5, 2**30, 80)])
def test_hard_negatives(spark, small, seed, scale, low):
    """Also with scores beyond what doubles, and 64 bits, hold."""
    rows = odd_rows(seed, spread=2 if scale > 1 else 5)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = negatives.hard_negatives(df, df.filter("vec_id % 20 = 0"), 4, 3, low, 100, scale)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 20 == 0, 4, 3, low, 100, scale)


def test_intervals_hold_all_products():
    rng = np.random.default_rng(2)
    a, c = rng.normal(size=(40, 5)), rng.normal(size=(50, 5)) + 1
    (ca, ra), (cc, rc) = ((x.mean(0)[None], np.sqrt(np.square(x - x.mean(0)).sum(1).max())[None]) for x in (a, c))
    low, high = negatives.interval(ca, ra, cc, rc)
    assert low[0, 0] <= (a @ c.T).min() and (a @ c.T).max() <= high[0, 0]


def test_pruning_leaves_work_out(monkeypatch):
    """In clusters far apart many pairs of leaves are never scored."""
    rng = np.random.default_rng(3)
    centres = 200 * rng.normal(size=(4, 8))
    vec = np.floor(centres[rng.integers(0, 4, 2048)] + rng.normal(size=(2048, 8)))
    label = np.arange(2048) % 3
    order, nodes = ann.grow(vec, rng, kept_in=True)
    shard = {"ids": np.arange(2048), "vec": vec[order], "label": label[order], **negatives.balls(vec[order], nodes, label[order])}
    own = {"vec": vec[:256], "label": label[:256]}
    least, most = np.full((256, 1), negatives.LEAST), np.full((256, 1), negatives.MOST)
    dual, scored = negatives.Dual(own, shard, 5, True, least, most, least), []
    monkeypatch.setattr(negatives.Dual, "leaves", lambda self, a, c, f=negatives.Dual.leaves: scored.append((a, c)) or f(self, a, c))
    dual.run()
    leaves = lambda nodes: int((nodes[:, 2] < 0).sum())
    assert len(scored) < 0.7 * leaves(dual.tree["nodes"]) * leaves(nodes)


def test_hard_negatives_query(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in own]
    assert sorted(map(tuple, op12_hard_negatives(spark, sf_dir).collect())) == brute_negatives(rows, lambda i: i % 100 == 0, 5, 5, 80, 100, 256, 64)


def test_rows_and_bodies_do_not_go_through_the_driver(spark):
    """Both compress to little on disk, by which Spark would broadcast them."""
    rows = spark.range(64).select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("id") + i).cast("double")).alias("vec"), F.lit(0).cast("long").alias("cell"))
    shards = vectors.make_shards(rows, lambda own, cell: ({"vec": own["vec"]}, {"n": len(own["vec"])}), "struct<n: bigint>")
    kernel = lambda own, shard: iter([{"id": own["id"]}])
    home = vectors.at_home(vectors.blocks(rows, "id"), shards, kernel, "id long")
    rest = vectors.elsewhere(vectors.blocks(rows, "id"), shards, lambda own, s: np.ones((len(own["id"]), len(s)), bool), kernel, "id long")
    for df in (home, rest):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        body = [line for line in plan.splitlines() if "Join" in line and "shard#" in line]
        assert body and all("strategy=merge" in line for line in body)
    assert sorted(r.id for r in home.collect()) == list(range(64)) and rest.count() == 0


def test_rows_move_once_to_a_group_and_few_are_held_at_once(spark, small, monkeypatch):
    """What is written is read a group of rows at a time, so groups of long rows must be small; a block's rows go to a group of shards, not to each."""
    monkeypatch.setattr(vectors, "PAGE_SHARDS", 32)
    monkeypatch.setattr(vectors, "LEAST_GROUPS", 4, raising=False)
    monkeypatch.setattr(vectors, "ASKING_ROWS", 5, raising=False)
    monkeypatch.setattr(vectors, "FOUND_ROWS", 20, raising=False)
    staged, cut, stage, cutting = {}, [], vectors.stage, vectors.blocks
    monkeypatch.setattr(vectors, "stage", lambda df, tag, **how: staged.setdefault(tag, stage(df, tag, **how)))
    monkeypatch.setattr(vectors, "blocks", lambda *a: cut.append(cutting(*a)) or cut[-1])
    rows = odd_rows(7, n=1600, spread=4)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    got = ann.nearest(df, df.filter("vec_id % 20 = 0"), 5, factor=1.0)
    assert sorted(map(tuple, got.collect())) == brute_nearest(rows, lambda i: i % 20 == 0, 5)
    shards = staged["shards"].count()
    assert shards > 32
    for tag in ("shards", "todo"):
        held = [m.row_group(g).num_rows for f in staged[tag].inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for g in range(m.num_row_groups)]
        assert max(held) <= 16 < sum(held)
    assert staged["todo"].count() <= 5 * cut[-1].count() < shards * cut[-1].count() / 6


@pytest.mark.parametrize("whole", [False, True])
def test_foremost_of_rows_found(whole):
    r = random.Random(8)
    least = np.iinfo(np.int64).min
    rows = [(f"k{r.randint(0, 9)}", r.randint(0, 2), i, r.choice([least, -1, 0, 5, 2**63 - 1]) if whole else r.choice([-0.5, 0.0, 0.25, 3.0]), False) for i in range(300)]
    schema = pa.schema([("kind", pa.string()), ("range", pa.int64()), ("id", pa.int64()), ("score", pa.int64() if whole else pa.float64()), ("same", pa.bool_())])
    found = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*r.sample(rows, 300)), schema)], schema=schema)
    want = {key: sorted((x for x in rows if x[:2] == key), key=lambda x: (-x[3], x[2]))[:4] for key in {x[:2] for x in rows}}
    assert sorted(map(tuple, vectors.foremost(found, 4).to_pandas().to_numpy().tolist())) == sorted(x for kept in want.values() for x in kept)
    assert vectors.foremost(found.slice(0, 0), 4).num_rows == 0
