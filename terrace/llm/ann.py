"""Nearest neighbours by inner product with a vantage-point tree in each shard.

Vectors are lifted into a metric space: with M the greatest norm, a vector x gets
one more component, sqrt(M^2 - |x|^2), a query gets 0; the largest inner product is
then the smallest Euclidean distance. In each shard a vantage-point tree parts rows
by their distance to one of them. The triangle inequality bounds the distance to
all rows of a subtree from below; a subtree is left out where that bound times
``factor`` is beyond the distance of the k-th row found. With factor 1 nothing is
lost; a greater factor leaves out more. Unless the factor is given, it is the
greatest of FACTORS that loses few enough neighbours in a search of the bounded
sample that the router is fitted on. Rows that are reached are scored exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import stage
from .vectors import Rows

#: Rows of a leaf, at most.
LEAF = 128
#: What the lower bounds may be multiplied with; 1 is exact.
FACTORS = (12.0, 10.0, 8.0, 7.0, 6.0, 5.5, 5.0, 4.5, 4.0, 3.5, 3.0, 2.5, 2.0, 1.5, 1.25)
#: Share of the neighbours that a search of the sample must find, and queries that it is tried with, at most.
TARGET, TRIED = 0.96, 256


def lift_rows(top: float) -> Callable[[np.ndarray], np.ndarray]:
    """Candidates as points; ``top`` is the square of the greatest norm."""
    return lambda x: np.c_[x, np.sqrt(np.maximum(top - np.square(x).sum(1), 0))]


def lift_queries(x: np.ndarray) -> np.ndarray:
    return np.c_[x, np.zeros(len(x))]


def grow(points: np.ndarray, rng: np.random.Generator, leaf: int = LEAF, kept_in: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points in which each subtree is a run, and the nodes, children after parents.

    A node is (first, last, inner child, outer child, and the least and greatest distance
    of the rows of either child to the row at ``first``); leaves have no children (-1).
    That row is apart from both children, or in the inner one where ``kept_in`` says so.
    """
    order, nodes = np.arange(len(points)), []
    todo = [(0, len(points), None)]
    while todo:
        first, last, above = todo.pop()
        here = len(nodes)
        nodes.append([first, last, -1, -1, 0, 0, 0, 0])
        if above is not None:
            nodes[above[0]][above[1]] = here
        own = order[first:last]
        if len(own) <= leaf:
            continue
        tries = rng.choice(len(own), min(8, len(own)), replace=False)
        apart = vectors.distances(points[own[tries]], points[own])
        best = int(np.argmax(apart.std(1)))
        own[[0, tries[best]]] = own[[tries[best], 0]]
        d = apart[best]
        d[[0, tries[best]]] = d[[tries[best], 0]]
        rest = np.argsort(d[1:], kind="stable") + 1
        own[1:], d[1:] = own[rest], d[rest]
        mid = 1 + len(rest) // 2
        nodes[here][4:] = [d[1], d[mid - 1], d[mid], d[-1]]
        todo += [(first + (not kept_in), first + mid, (here, 2)), (first + mid, last, (here, 3))]
    return order, np.array(nodes, float)


class Search:
    """Queries on their way through the tree of a shard; of each the ``k`` best rows so far."""

    def __init__(self, rows: Rows, shard: Rows, k: int, factor: float, top: float):
        self.q, self.x, self.ids, self.nodes = rows["vec"], shard["vec"], shard["ids"], shard["nodes"]
        self.k, self.factor = k, factor
        self.far = np.square(self.q).sum(1) + top  # squared distance of a row that scores 0
        self.slack = 1e-12 * (np.sqrt(self.far) * np.sqrt(top) + 1e-300)
        self.floor = np.array(rows["least"], float)  # scores below have been beaten elsewhere
        self.open = self.floor == -np.inf
        self.score = np.full((len(self.q), k), -np.inf)
        self.id = np.full((len(self.q), k), np.iinfo(np.int64).max)
        self.own = np.zeros((len(self.q), k), bool)

    def least(self, act: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[act, -1], self.floor[act]) - self.slack[act]

    def reach(self, act: np.ndarray) -> np.ndarray:
        """Distance that a row must not exceed to count."""
        least = self.least(act)
        return np.sqrt(np.maximum(np.where(np.isfinite(least), self.far[act] - 2 * least, np.inf), 0)) * (1 + 1e-9) + 1e-9 * np.sqrt(self.far[act])

    def take(self, act: np.ndarray, rough: np.ndarray, first: int) -> None:
        """Score the rows from ``first`` on that may count, as the sum of products in a fixed order, and keep the best."""
        hit = rough >= self.least(act)[:, None]
        some = np.flatnonzero(hit.any(1))
        if not some.size:
            return
        n, r = np.nonzero(hit[some])
        new = np.full((len(some), rough.shape[1]), -np.inf)
        q, x = self.q[act[some[n]]], self.x[first + r]
        new[n, r] = (q * x).sum(1)
        same = np.zeros(new.shape, bool)
        same[n, r] = (q == x).all(1)
        own = act[some]
        score = np.c_[self.score[own], new]
        ids = np.c_[self.id[own], np.broadcast_to(self.ids[first : first + rough.shape[1]], new.shape)]
        order = np.lexsort((ids, -score), axis=-1)[:, : self.k]
        self.score[own], self.id[own] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        self.own[own] = np.take_along_axis(np.c_[self.own[own], same], order, 1)

    def visit(self, node: int, act: np.ndarray) -> None:
        """All rows of a node that may count for the queries ``act``, the nearer child first."""
        if not act.size:
            return
        first, last, inner, outer = self.nodes[node, :4].astype(int)
        if inner < 0:
            self.take(act, self.q[act] @ self.x[first:last].T, first)
            return
        rough = self.q[act] @ self.x[first]
        self.take(act, rough[:, None], first)
        apart = np.sqrt(np.maximum(self.far[act] - 2 * rough, 0))
        low_in, high_in, low_out, high_out = self.nodes[node, 4:]
        nearer = apart <= (high_in + low_out) / 2
        bound = {inner: np.maximum(apart - high_in, low_in - apart), outer: np.maximum(apart - high_out, low_out - apart)}
        if self.open[act].any():  # nothing is known yet, so each query goes down its own side first
            turns = [(c, side) for one, other, side in ((inner, outer, nearer), (outer, inner, ~nearer)) for c in (one, other)]
        else:
            turns = [(c, np.ones(len(act), bool)) for c in ((inner, outer) if 2 * nearer.sum() >= len(act) else (outer, inner))]
        for child, side in turns:
            self.visit(child, act[side][bound[child][side] * self.factor <= self.reach(act[side])])

    def found(self) -> Iterator[Rows]:
        n, r = np.nonzero((self.score > -np.inf) & (self.score >= self.floor[:, None]))
        if n.size:
            yield {"at": n, "id": self.id[n, r], "score": self.score[n, r], "same": self.own[n, r]}


def calibrated(x: np.ndarray, q: np.ndarray, k: int, top: float) -> float:
    """The greatest factor with which queries ``q`` find enough of their ``k`` nearest rows among ``x``.

    The tree is deep and the bound is that of the k-th row from the start, so a search
    that has to find its bounds first loses less.
    """
    order, nodes = grow(lift_rows(top)(x), np.random.default_rng(0), 32)
    k = min(k, len(x))
    least = -np.partition(-(q @ x.T), k - 1, axis=1)[:, k - 1]
    shard, own = {"ids": order, "vec": x[order], "nodes": nodes}, {"vec": q, "least": least - 1e-9 * np.abs(least)}
    for factor in FACTORS:
        search = Search(own, shard, k, factor, top)
        search.visit(0, np.arange(len(q)))
        if (search.score > -np.inf).mean() >= TARGET:
            return factor
    return 1.0


def nearest(df: DataFrame, queries: DataFrame, k: int, factor: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of ``df`` found nearest to each row of ``queries``, itself left out.

    ``factor`` relaxes the pruning; None sets it for few losses, 1 finds all.
    Nearness is the inner product in double precision, ties go to the smaller id.
    Rows whose id or vector is null, whose vector is empty, zero or holds null or
    non-finite components, or isn't of the most frequent length, take no part on
    either side. Each row stands for itself: of rows that repeat an id, or an id and
    its vector, each is a candidate and each asks; a query leaves out one row, of its
    own id and vector. Fewer candidates than ``k`` are all returned. Other columns are
    not read. An empty table gives no rows.
    """

    def read(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
        return rows.filter(F.col("id").isNotNull() & vectors.finite(F.col("vec")) & F.exists("vec", lambda x: x != 0))

    rows, dim = vectors.one_length(read(df))
    kept = stage(vectors.first_copies(rows, k + 1), "vectors")
    count, top = kept.agg(F.count(F.lit(1)), F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()
    top = (top or 0.0) * (1 + 1e-12)
    sample = vectors.sample(kept, count)
    router = vectors.Router(lift_rows(top)(sample), count)

    def build(own: Rows, cell: int):
        points = lift_rows(top)(own["vec"])
        order, nodes = grow(points, np.random.default_rng(cell))
        path = router.paths[cell]
        apart = vectors.distances(router.vantage[list(path)], points) if path else np.zeros((0, 1))
        said = {"path": list(path), "low": apart.min(1).tolist(), "high": apart.max(1).tolist()}
        return {"ids": own["id"][order], "vec": own["vec"][order], "nodes": nodes}, said

    shards = vectors.make_shards(vectors.routed(kept, router, lift_rows(top)), build, "struct<path: array<long>, low: array<double>, high: array<double>>")
    asked = read(queries).filter(F.size("vec") == dim)
    asked = asked.withColumn("kind", F.sha2(F.array_join(F.transform("vec", lambda x: x.cast("string")), " "), 256))
    kinds = stage(asked.groupBy("kind").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n")), "kinds")
    whole = stage(vectors.routed(kinds.select("kind", "vec"), router, lift_queries), "queries")

    if factor is None:  # of the rows in the sample, about as many are near a query as fall to the sample's share
        tried = np.array([r["vec"] for r in kinds.orderBy(F.xxhash64("kind")).limit(TRIED).select("vec").collect()], float)
        factor = calibrated(sample, tried, 1 + max(1, round(k * len(sample) / count)), top) if len(tried) and count else 1.0

    def kernel(own: Rows, shard: Rows) -> Iterator[Rows]:
        search = Search(own, shard, k + 1, factor, top)
        search.visit(0, np.arange(len(own["vec"])))
        for x in search.found():
            yield {"kind": own["kind"][x["at"]], "id": x["id"], "score": x["score"], "same": x["same"]}

    def may_hold(own: Rows, shards: list[dict]) -> np.ndarray:
        reach = Search(own, {"vec": None, "ids": None, "nodes": None}, k + 1, factor, top).reach(np.arange(len(own["vec"])))
        apart = vectors.distances(lift_queries(own["vec"]), router.vantage) if len(router.vantage) else None
        out = np.ones((len(reach), len(shards)), bool)
        for n, s in enumerate(shards):
            if s["path"]:
                d = apart[:, s["path"]]
                bound = np.maximum(d - np.array(s["high"]), np.array(s["low"]) - d).max(1)
                out[:, n] = bound * factor <= reach
        return out

    schema = "kind string, id long, score double, same boolean"
    none = F.lit(float("-inf"))
    first = stage(vectors.at_home(vectors.blocks(whole.withColumn("least", none), "kind"), shards, kernel, schema), "home")
    least = first.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") > k).drop("n")
    seeded = whole.join(least, "kind", "left").withColumn("least", F.coalesce("least", none))
    rest = vectors.elsewhere(vectors.blocks(seeded, "kind"), shards, may_hold, kernel, schema, k + 1)
    best = Window.partitionBy("kind").orderBy(F.desc("score"), "id")
    ranked = first.unionByName(rest).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    lists = ranked.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score", "same"))).alias("found"))
    met = vectors.per_row(asked.select("kind", F.col("id").alias("query_id")), kinds, lists, "query_id")
    own = F.filter("found", lambda x: x["same"] & (x["id"] == F.col("query_id")))
    left = F.filter("found", lambda x: x["place"] != F.coalesce(F.get(own, F.lit(0))["place"], F.lit(k + 1)))
    out = met.select("query_id", F.posexplode(left).alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))
