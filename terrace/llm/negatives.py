"""Hard negatives by a dual-tree search.

Anchors and candidates are cut into blocks and shards of near rows, each with a
tree of balls (centre and radius of the rows below a node). For a node of anchors
and one of candidates, with centres a, c and radii r, s, every inner product lies
within |a|s + |c|r + rs of a.c. A pair of nodes whose interval can't hold a score
that any anchor below still looks for, or whose labels can't fit, is left out with
all its anchors at once; pairs of leaves are scored exactly, in integers.

The search runs twice, first for the positives of each anchor, then for the
negatives in the range of scores that each positive opens. Both start in a shard
near the anchors, which gives the bounds for all other shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ann, vectors
from .common import stage
from .vectors import Rows

#: Anchors of a leaf, at most.
LEAF = 32
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def whole_numbers(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as doubles; from 2^52 on doubles are whole anyway."""
    return F.transform(vec, lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale))


def balls(points: np.ndarray, nodes: np.ndarray, labels: np.ndarray) -> Rows:
    """Centre, radius and least and greatest label below each node; ``points`` are in the order of the nodes."""
    runs = [slice(int(a), int(b)) for a, b in nodes[:, :2]]
    centre = np.array([points[r].mean(0) for r in runs]).reshape(len(runs), -1)
    return {"nodes": nodes, "centre": centre, "radius": np.array([np.sqrt(np.square(points[r] - c).sum(1).max()) for r, c in zip(runs, centre)]), "low": np.array([labels[r].min() for r in runs]), "high": np.array([labels[r].max() for r in runs])}


def interval(a: np.ndarray, r: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product between balls, for all pairs of them."""
    middle, size_a, size_c = a @ c.T, np.sqrt(np.square(a).sum(1)), np.sqrt(np.square(c).sum(1))
    reach = size_a[:, None] * s + r[:, None] * size_c + r[:, None] * s
    reach += 1e-9 * (np.abs(middle) + reach + size_a[:, None] * size_c) + 1
    return middle - reach, middle + reach


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers as 64-bit integers; those that don't fit become the nearest that does."""
    if np.abs(a).max() * np.abs(c).max() * a.shape[1] < 2.0**53:
        return (a @ c.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    return np.clip(exact(a) @ exact(c).T, LEAST, MOST).astype(np.int64)


class Dual:
    """The anchors of a block against the rows of a shard; of each anchor and range of scores the ``k`` best rows.

    ``low`` and ``high`` (anchors x ranges) bound the scores looked for, ``least`` is
    what the k-th row found elsewhere has; ``alike`` asks for rows of the anchor's label,
    otherwise for rows of another one.
    """

    def __init__(self, own: Rows, shard: Rows, k: int, alike: bool, low: np.ndarray, high: np.ndarray, least: np.ndarray):
        order, nodes = ann.grow(own["vec"], np.random.default_rng(1), LEAF, kept_in=True)
        self.order, self.vec, self.label = order, own["vec"][order], own["label"][order]
        self.low, self.high = np.maximum(low, least)[order], high[order]
        self.tree = balls(self.vec, nodes, self.label)
        self.shard, self.k, self.alike = shard, k, alike
        self.below, self.above = interval(self.tree["centre"], self.tree["radius"], shard["centre"], shard["radius"])
        self.score = np.full((*low.shape, k), LEAST)
        self.id = np.full((*low.shape, k), MOST)
        self.same = np.zeros((*low.shape, k), bool)
        self.filled = np.zeros((*low.shape, k), bool)

    def hopeless(self, a: int, c: int) -> bool:
        low_a, high_a, low_c, high_c = self.tree["low"][a], self.tree["high"][a], self.shard["low"][c], self.shard["high"][c]
        if (high_a < low_c or high_c < low_a) if self.alike else (low_a == high_a == low_c == high_c):
            return True
        own = slice(*self.tree["nodes"][a, :2].astype(int))
        return not ((self.low[own] <= self.above[a, c]) & (self.high[own] >= self.below[a, c])).any()

    def leaves(self, a: int, c: int) -> None:
        own, rows = slice(*self.tree["nodes"][a, :2].astype(int)), slice(*self.shard["nodes"][c, :2].astype(int))
        scores = products(self.vec[own], self.shard["vec"][rows])
        fit = (self.label[own, None] == self.shard["label"][rows]) == self.alike
        for j in range(self.low.shape[1]):
            hit = fit & (scores >= self.low[own, j, None]) & (scores <= self.high[own, j, None])
            some = np.flatnonzero(hit.any(1))
            if not some.size:
                continue
            at = own.start + some
            new = np.where(hit[some], scores[some], LEAST)
            ids = np.where(hit[some], self.shard["ids"][rows], MOST)
            same = hit[some]
            n, r = np.nonzero(same)
            same[n, r] = (self.vec[at[n]] == self.shard["vec"][rows][r]).all(1)
            score, ids, same, filled = np.c_[self.score[at, j], new], np.c_[self.id[at, j], ids], np.c_[self.same[at, j], same], np.c_[self.filled[at, j], hit[some]]
            order = np.lexsort((ids, -score.astype(float), ~filled) if np.abs(score[filled]).max() < 2**53 else (ids, np.where(filled, -(score + 1), 0), ~filled), axis=-1)[:, : self.k]
            for kept, all_ in ((self.score, score), (self.id, ids), (self.same, same), (self.filled, filled)):
                kept[at, j] = np.take_along_axis(all_, order, 1)
            full = self.filled[at, j, -1]
            self.low[at[full], j] = np.maximum(self.low[at[full], j], self.score[at[full], j, -1])

    def run(self) -> None:
        todo = [(0, 0)] if len(self.shard["nodes"]) else []
        while todo:
            a, c = todo.pop()
            if self.hopeless(a, c):
                continue
            under_a, under_c = (t["nodes"][n, 2:4].astype(int) for t, n in ((self.tree, a), (self.shard, c)))
            if under_a[0] < 0 and under_c[0] < 0:
                self.leaves(a, c)
            elif under_a[0] < 0 or (under_c[0] >= 0 and self.shard["radius"][c] >= self.tree["radius"][a]):
                todo += sorted(((a, int(x)) for x in under_c), key=lambda x: self.above[x])  # the more promising child is taken first
            else:
                todo += [(int(x), c) for x in under_a]

    def found(self) -> Iterator[Rows]:
        n, j, r = np.nonzero(self.filled & (self.score >= self.low[:, :, None]))
        if n.size:
            yield {"at": self.order[n], "range": j, "id": self.id[n, j, r], "score": self.score[n, j, r], "same": self.same[n, j, r]}


def ranges(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of negatives, in percent of those of the positives; empty where these are negative."""
    each = [[int(x) for x in row] for row in scores]
    least = [[min(MOST, max(LEAST, -(-low * x // 100))) for x in row] for row in each]
    most = [[min(MOST, max(LEAST, high * x // 100)) for x in row] for row in each]
    return np.array(least, np.int64).reshape(scores.shape), np.array(most, np.int64).reshape(scores.shape)


def hard_negatives(df: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(scale * x), and a row's score is its inner product
    with the anchor: an exact integer, or the nearest 64-bit one. Higher scores come
    first, ties by the smaller id. Positives are an anchor's first ``positives`` other
    rows of its label; each opens the range from ``low`` to ``high`` percent of its
    score, of which the first ``negatives`` rows of other labels are returned.

    Rows whose id, label or vector is null, whose vector is empty, holds null or
    non-finite components, or isn't of the most frequent length, take no part on
    either side. Each row stands for itself, also where it repeats an id or another
    row. Labels are integers; other columns are not read. An anchor without positives,
    and a positive without negatives, gives no rows; so does an empty table.
    """

    def read(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"), F.col(label_col).cast("long").alias("label"))
        return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & vectors.finite(F.col("vec"))).withColumn("vec", whole_numbers(F.col("vec"), scale))

    k = positives + 1  # and the anchor itself
    rows, dim = vectors.one_length(read(df))
    kept = stage(vectors.first_copies(rows, max(k, negatives), "label"), "vectors")
    count = kept.count()
    router = vectors.Router(vectors.sample(kept, count), count)

    def build(own: Rows, cell: int):
        order, nodes = ann.grow(own["vec"], np.random.default_rng(cell), kept_in=True)
        tree = balls(own["vec"][order], nodes, own["label"][order])
        said = {"centre": tree["centre"][0].tolist(), "radius": float(tree["radius"][0]), "low": int(tree["low"][0]), "high": int(tree["high"][0])}
        return {"ids": own["id"][order], "vec": own["vec"][order], "label": own["label"][order], **tree}, said

    shards = vectors.make_shards(vectors.routed(kept, router, lambda x: x), build, "struct<centre: array<double>, radius: double, low: bigint, high: bigint>")
    asked = read(anchors).filter(F.size("vec") == dim)
    spelt = F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")
    asked = asked.withColumn("kind", F.sha2(F.concat_ws("|", spelt, "label"), 256))
    kinds = stage(asked.groupBy("kind").agg(F.first("vec").alias("vec"), F.first("label").alias("label"), F.count(F.lit(1)).alias("n")), "kinds")
    whole = stage(vectors.routed(kinds.select("kind", "vec", "label"), router, lambda x: x), "anchors")

    def search(alike: bool, most: int, own: Rows, shard: Rows) -> Dual:
        if alike:
            bounds = np.full((len(own["vec"]), 1), LEAST), np.full((len(own["vec"]), 1), MOST)
        else:
            bounds = ranges(own["scores"], low, high)
        return Dual(own, shard, most, alike, *bounds, own["least"].reshape(bounds[0].shape))

    def two_steps(asking: DataFrame, alike: bool, most: int, n: int) -> DataFrame:
        """kind, range, id, score, same: the best ``most`` rows of each kind and range, from the shard near by and then from all others."""

        def kernel(own: Rows, shard: Rows) -> Iterator[Rows]:
            dual = search(alike, most, own, shard)
            dual.run()
            for x in dual.found():
                yield {"kind": own["kind"][x["at"]], "range": x["range"], "id": x["id"], "score": x["score"], "same": x["same"]}

        def may_hold(own: Rows, shards: list[dict]) -> np.ndarray:
            tree = {c: np.array([s[c] for s in shards]) for c in ("centre", "radius", "low", "high")}
            dual = search(alike, most, own, tree | {"nodes": np.zeros((0, 8))})
            if all(dual.hopeless(0, n) for n in range(len(shards))):  # one test for the whole block
                return np.zeros((len(own["vec"]), len(shards)), bool)
            below, above = interval(dual.vec, np.zeros(len(dual.vec)), tree["centre"], tree["radius"])
            out = ((dual.low[:, None] <= above[:, :, None]) & (dual.high[:, None] >= below[:, :, None])).any(2)
            label = dual.label[:, None]
            out &= (label >= tree["low"]) & (label <= tree["high"]) if alike else (label != tree["low"]) | (label != tree["high"])
            return out[np.argsort(dual.order)]

        schema = "kind string, range long, id long, score long, same boolean"
        lowest = F.array_repeat(F.lit(int(LEAST)), n)
        first = stage(vectors.at_home(vectors.blocks(asking.withColumn("least", lowest), "kind"), shards, kernel, schema), "home")
        full = first.groupBy("kind", "range").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= most)
        bound = full.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("range", "least"))).alias("bounds"))
        each = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda j: F.coalesce(F.try_element_at("bounds", j), F.lit(int(LEAST))))
        seeded = asking.join(bound, "kind", "left").withColumn("least", F.when(F.col("bounds").isNull(), lowest).otherwise(each)).drop("bounds")
        rest = vectors.elsewhere(vectors.blocks(seeded, "kind"), shards, may_hold, kernel, schema, most)
        w = Window.partitionBy("kind", "range").orderBy(F.desc("score"), "id")
        return first.unionByName(rest).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)

    near = stage(two_steps(whole, True, k, 1).select("kind", "place", "id", "score", "same"), "positives")
    by_place = F.array_sort(F.collect_list(F.struct("place", "id", "score", "same")))
    # Places that no positive takes get -1, which opens no range.
    scores = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: F.coalesce(F.try_element_at(F.col("near"), j)["score"], F.lit(-1).cast("long")))
    opened = stage(vectors.shuffled(whole).join(near.groupBy("kind").agg(by_place.alias("near")), "kind").withColumn("scores", scores).drop("near"), "opened")
    hard = two_steps(opened, False, negatives, k)
    hard = hard.groupBy("kind", (F.col("range") + 1).cast("int").alias("place")).agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("rank"), "id", "score"))).alias("hard"))
    lists = near.join(hard, ["kind", "place"], "left").groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score", "same", "hard"))).alias("near"))
    met = vectors.per_row(asked.select("kind", F.col("id").alias("anchor_id")), kinds, lists, "anchor_id")
    own = F.get(F.filter("near", lambda x: x["same"] & (x["id"] == F.col("anchor_id"))), F.lit(0))["place"]
    others = F.filter("near", lambda x: x["place"] != F.coalesce(own, F.lit(k)))
    out = met.select("anchor_id", F.explode(others).alias("p")).select("anchor_id", "p", F.explode("p.hard").alias("h"))
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("h.rank").cast("int").alias("rank"), F.col("h.id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("h.score").alias("negative_score"))
