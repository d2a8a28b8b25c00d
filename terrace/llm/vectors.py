"""What searches over vectors share: rows that take part, shards of near rows, blocks of queries.

Rows are dealt into cells by a router, a small vantage-point tree that is fitted on
a bounded sample (SAMPLE rows) but routes every row. Cells are dealt into shards of
about SHARD_ROWS rows by a hash, so no shard grows with the data or with a cell.
Queries go the same way into blocks of about BLOCK_ROWS rows. A search first lets
each block meet one shard of its own cell, which bounds what it still looks for;
then blocks meet summaries of the shards, a page of them at a time, and only the
rows of a block that a summary doesn't rule out move on, once to a group of shards.
A task holds the shards of a group and the rows of a part of the blocks, each of
about HELD_BYTES at most.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import bounded
from .common import few, kept_in_worker, stage

#: Rows the router is fitted on, about; rows of a shard and of a block, about; shards on a page.
SAMPLE, SHARD_ROWS, BLOCK_ROWS, PAGE_SHARDS = 8192, 4096, 512, 256
#: Bytes of the shards of a group, and of the rows of a part, about; groups that shards are dealt into at least, where there are so many shards.
HELD_BYTES, LEAST_GROUPS = 32_000_000, 32
#: Written shards, and blocks, that a writer or reader holds at once; rows that search a shard at once; rows found that a task gathers before it keeps the best.
STAGED_ROWS, ASKING_ROWS, FOUND_ROWS = 16, 4096, 200_000
#: Rows of one kind, at most, that a list is joined with in one task.
COPIES = 4096

Rows = dict[str, np.ndarray]
Kernel = Callable[[Rows, Rows], Iterator[Rows]]


def finite(vec: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vec) > 0) & fine, F.lit(False))


def one_length(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows whose ``vec`` has the most frequent length (of equally frequent ones the greatest), and that length; 0 without rows."""
    top = df.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return (df.filter(F.size("vec") == top["n"]), top["n"]) if top else (df, 0)


def first_copies(df: DataFrame, n: int, *same: str) -> DataFrame:
    """Of rows with equal ``vec`` and ``same`` the ``n`` with the smallest ids: no search for fewer than ``n`` rows can find another."""
    w = Window.partitionBy(F.xxhash64("vec", *same), "vec", *same).orderBy("id")
    return df.withColumn("__copy", F.row_number().over(w)).filter(F.col("__copy") <= n).drop("__copy")


class Router:
    """A vantage-point tree over points; its leaves are cells."""

    def __init__(self, points: np.ndarray, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.vantage, self.radius, self.child, self.paths = [], [], [], []
        todo: list[tuple[np.ndarray, tuple[int, ...], tuple[int, int] | None]] = [(np.arange(len(points)), (), None)]
        while todo:
            own, path, above = todo.pop()
            split = None
            if len(own) >= 16 and len(own) / len(points) * rows > SHARD_ROWS:
                tries = [points[i] for i in rng.choice(own, min(8, len(own)), replace=False)]
                far = [distances(v[None], points[own])[0] for v in tries]
                best = int(np.argmax([d.std() for d in far]))
                radius = float(np.median(far[best]))
                inside = far[best] <= radius
                split = (tries[best], radius, own[inside], own[~inside]) if not inside.all() else None
            here = len(self.radius) if split else ~len(self.paths)
            if above is not None:
                self.child[above[0]][above[1]] = here
            if split is None:
                self.paths.append(path)
                continue
            self.vantage.append(split[0])
            self.radius.append(split[1])
            self.child.append([0, 0])
            todo += [(split[2], (*path, here), (here, 0)), (split[3], (*path, here), (here, 1))]
        self.vantage = np.array(self.vantage).reshape(len(self.radius), points.shape[1])
        self.radius, self.child = np.array(self.radius), np.array(self.child, np.int64).reshape(-1, 2)

    def route(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        at = np.full(len(points), 0 if len(self.radius) else -1)
        while (open_ := np.flatnonzero(at >= 0)).size:
            node = at[open_]
            apart = np.sqrt(np.square(points[open_] - self.vantage[node]).sum(1))
            at[open_] = self.child[node, (apart > self.radius[node]).astype(int)]
        return ~at


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` and ``b``."""
    return np.sqrt(np.maximum(np.square(a).sum(1)[:, None] + np.square(b).sum(1) - 2 * a @ b.T, 0))


def numpy_rows(rows: pa.StructArray) -> Rows:
    """Fields of an array of structs; lists of one length each become matrices."""
    out = {}
    for field in rows.type:
        x = rows.field(field.name)
        if pa.types.is_list(field.type):
            flat = x.flatten().to_numpy(zero_copy_only=False)
            out[field.name] = flat.reshape(len(rows), -1)
        else:
            out[field.name] = x.to_numpy(zero_copy_only=False)
    return out


def packed(arrays: Rows) -> bytes:
    held = io.BytesIO()
    np.savez(held, **arrays)
    return held.getvalue()


def unpacked(body: bytes) -> Rows:
    with np.load(io.BytesIO(body)) as x:
        return dict(x)


def sample(rows: DataFrame, count: int) -> np.ndarray:
    """About SAMPLE vectors of ``count`` rows, chosen by a hash of the vector."""
    every = max(1, count // SAMPLE)
    found = rows.filter(F.pmod(F.xxhash64("vec", F.lit("sample")), F.lit(every)) == 0).select("vec").limit(2 * SAMPLE).toArrow()
    points = np.array(found.column(0).to_pylist(), float)
    return np.unique(points, axis=0) if len(points) else np.zeros((1, 1))


def routed(rows: DataFrame, router: Router, lift: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``rows`` with their cell."""
    at = rows.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("vectors")
        for batch in batches:
            vec = batch.column(at)
            points = vec.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            cells = router.route(lift(points)) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int64())], names=[*batch.schema.names, "cell"])

    schema = rows.withColumn("cell", F.lit(0).cast("long")).schema
    return rows.mapInArrow(run, schema)


def dealt(rows: DataFrame, most: int, name: str, key: Column) -> DataFrame:
    """``rows`` with a number ``name``: each cell is dealt by a hash of ``key`` into parts of about ``most`` rows; ``first`` and ``parts`` are those of the cell.

    A cell is a leaf of the router, so the table of cells is bounded by its sample.
    """
    spark, at, cells = rows.sparkSession, 0, []
    for cell, n in sorted(map(tuple, rows.groupBy("cell").count().collect())):
        cells.append((cell, at, -(-n // most)))
        at += cells[-1][2]
    known = F.broadcast(spark.createDataFrame(cells, "cell long, first long, parts long"))
    return rows.join(known, "cell").withColumn(name, F.col("first") + F.pmod(key, F.col("parts")))


def make_shards(rows: DataFrame, build: Callable[[Rows, int], tuple[Rows, dict[str, Any]]], summary: str) -> DataFrame:
    """shard, cell, body, bytes, summary: a written shard a row, from rows with ``cell``; ``build`` makes the packed arrays, of so many bytes, and the summary."""
    cols = [c for c in rows.columns if c != "cell"]
    own = dealt(rows, SHARD_ROWS, "shard", F.xxhash64(*cols, F.lit("shard"))).groupBy("shard").agg(F.first("cell").alias("cell"), F.first("first").alias("first"), F.first("parts").alias("parts"), F.collect_list(F.struct(*cols)).alias("rows"))
    schema = f"shard long, cell long, first long, parts long, body binary, bytes long, summary {summary}"
    kind = pa.schema([("x", _arrow(own.sparkSession, summary))]).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("vectors")
        for batch in batches:
            for n in range(batch.num_rows):
                one = batch.slice(n, 1)
                arrays, said = build(numpy_rows(one.column(4).flatten()), one.column(1)[0].as_py())
                body = packed(arrays)
                yield pa.RecordBatch.from_arrays([*one.columns[:4], pa.array([body], pa.binary()), pa.array([len(body)], pa.int64()), pa.array([said], kind)], names=["shard", "cell", "first", "parts", "body", "bytes", "summary"])

    return stage(own.mapInArrow(run, schema), "shards", rows=STAGED_ROWS)


def _arrow(spark, ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark.createDataFrame([], f"x {ddl}").schema[0].dataType)


def blocks(rows: DataFrame, key: str) -> DataFrame:
    """block, cell, rows: about BLOCK_ROWS rows of a cell in one row; ``key`` tells rows apart."""
    cols = [c for c in rows.columns if c != "cell"]
    cut = dealt(rows, BLOCK_ROWS, "block", F.xxhash64(key, F.lit("block")))
    return cut.groupBy("block").agg(F.first("cell").alias("cell"), F.collect_list(F.struct(*cols)).alias("rows"))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that shuffles: written rows and bodies take a small part of their size on disk, by which Spark would send them through the driver to all executors."""
    return df.hint("merge")


def searched(pairs: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    """Rows that ``kernel`` finds for each (rows, body)."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("vectors")
        for batch in batches:
            for n in range(batch.num_rows):
                one = batch.slice(n, 1)
                for found in kernel(numpy_rows(one.column(0).flatten()), unpacked(one.column(1)[0].as_py())):
                    yield pa.RecordBatch.from_arrays([pa.array(found[c]) for c in names], names=names)

    return pairs.select("rows", "body").mapInArrow(run, schema)


def at_home(own: DataFrame, shards: DataFrame, kernel: Kernel, schema: str) -> DataFrame:
    """What each block finds in one shard of its own cell; blocks of a cell take its shards in turn. A cell without rows gives nothing."""
    place = shards.select("cell", "first", "parts").distinct()  # as many rows as the router has cells
    homes = own.join(F.broadcast(place), "cell").select("rows", (F.col("first") + F.pmod("block", "parts")).alias("shard"))
    return searched(homes.join(shuffled(shards.select("shard", "body")), "shard"), kernel, schema)


def foremost(found: pa.Table, most: int) -> pa.Table:
    """Of the rows of each kind, and range, the ``most`` that come first by score, then id."""
    kind, score = found["kind"].combine_chunks().dictionary_encode().indices.to_numpy(), found["score"].to_numpy()
    span = found["range"].to_numpy() if "range" in found.column_names else np.zeros(len(kind), np.int64)
    order = np.lexsort((found["id"].to_numpy(), ~score if score.dtype == np.int64 else -score, span, kind))
    n = np.arange(len(order))
    new = np.r_[True, (np.diff(kind[order]) != 0) | (np.diff(span[order]) != 0)][: len(n)]
    return found.take(pa.array(order[n - np.maximum.accumulate(np.where(new, n, 0)) < most]))


def elsewhere(own: DataFrame, shards: DataFrame, may_hold: Callable[[Rows, list[dict]], np.ndarray], kernel: Kernel, schema: str, most: int | None = None) -> DataFrame:
    """What blocks find in all shards but that of ``at_home``; ``may_hold`` tells which rows of a block must look into which shards of a page.

    Only the ``most`` rows found of a kind, and range, that come first by score, then id, count, if it is given.
    """
    page = F.floor(F.col("shard") / PAGE_SHARDS)
    pages = few(shards.groupBy(page.alias("page")).agg(F.collect_list(F.struct("shard", "cell", "first", "parts", "summary")).alias("shards")), "pages", F.lit(PAGE_SHARDS * 4096))
    last, held = shards.agg(F.max("shard"), F.max("bytes")).first()
    last, held = int(last or 0), int(held or 1)
    size = max(1, min(HELD_BYTES // held, (last + 1) // LEAST_GROUPS, 63))  # shards of a group; a row's `look` has a bit for each
    blocks_ = max(1, HELD_BYTES * SHARD_ROWS // (held * BLOCK_ROWS))  # blocks of a part
    met = own.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(last // PAGE_SHARDS)))).join(pages, "page").select("block", "cell", "rows", "shards")
    fields = own.schema["rows"].dataType.elementType.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_in_worker("vectors")
        for batch in batches:
            for n in range(batch.num_rows):
                block, cell, page = batch.column(0)[n].as_py(), batch.column(1)[n].as_py(), batch.column(3)[n].as_py()
                rows = batch.slice(n, 1).column(2).flatten()
                look = may_hold(numpy_rows(rows), [s["summary"] for s in page])
                groups: dict[int, np.ndarray] = {}
                for k, s in enumerate(page):
                    home = s["cell"] == cell and s["shard"] == s["first"] + block % s["parts"]
                    if not home and look[:, k].any():
                        bits = groups.setdefault(s["shard"] // size, np.zeros(len(look), np.int64))
                        bits |= look[:, k].astype(np.int64) << s["shard"] % size
                for group, bits in groups.items():
                    some = pa.array(bits != 0)
                    left = rows.filter(some)
                    left = pa.StructArray.from_arrays([*(left.field(f.name) for f in left.type), pa.array(bits[bits != 0])], names=[*(f.name for f in left.type), "look"])
                    wanted = pa.array([[group * size + k for k in range(size) if (bits >> k & 1).any()]], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([block // blocks_], pa.int64()), wanted, pa.ListArray.from_arrays(pa.array([0, len(left)], pa.int32()), left)], names=["group", "part", "wanted", "rows"])

    todo = stage(met.mapInArrow(run, f"group long, part long, wanted array<long>, rows array<struct<{fields}, look: bigint>>"), "todo", rows=STAGED_ROWS)
    pairs = todo.select(F.col("group").alias("of"), F.col("part").alias("at"), F.explode("wanted").alias("shard")).distinct()
    bodies = shuffled(shards.select("shard", "body")).join(pairs, "shard")
    types = pa.schema(list(_arrow(own.sparkSession, f"struct<{schema}>")))

    def search(key: tuple[pa.Scalar, ...], asking: pa.Table, bodies: pa.Table) -> pa.Table:
        kept_in_worker("vectors")
        own = numpy_rows(pa.concat_arrays([x.flatten() for x in asking["rows"].chunks]))
        look, found, held = own.pop("look"), [], 0
        for shard, body in zip(bodies["shard"].to_pylist(), bodies["body"]):
            at, arrays = np.flatnonzero(look >> shard % size & 1), unpacked(body.as_py())
            for start in range(0, len(at), ASKING_ROWS):
                some = at[start : start + ASKING_ROWS]
                for x in kernel({c: v[some] for c, v in own.items()}, arrays):
                    found.append(pa.RecordBatch.from_arrays([pa.array(x[f.name], f.type) for f in types], schema=types))
                    held += found[-1].num_rows
            if most is not None and held > FOUND_ROWS:
                found = foremost(pa.Table.from_batches(found), most).to_batches()
                held = sum(x.num_rows for x in found)
        out = pa.Table.from_batches(found, types)
        return out if most is None else foremost(out, most)

    return todo.select("group", "part", "rows").groupBy("group", "part").cogroup(bodies.groupBy("of", "at")).applyInArrow(search, schema)


def per_row(each: DataFrame, kinds: DataFrame, lists: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``each`` with the list of their kind. Kinds of more than COPIES rows (``n``) are dealt in parts."""
    hot = bounded(kinds.filter(F.col("n") > COPIES).select("kind", F.ceil(F.col("n") / COPIES).alias("parts")))
    part = F.pmod(F.xxhash64(id_col), F.coalesce("parts", F.lit(1))).alias("part")
    copies = lists.join(hot, "kind", "left").select(*lists.columns, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return each.join(hot, "kind", "left").select(*each.columns, part).join(copies, ["kind", "part"])
