"""Near duplicates by SetSketch registers.

A document's set holds its distinct word shingles, as 64-bit hashes. Register i
keeps the least of exponentially distributed values of the members, on a scale of
powers of BASE and truncated to LAST levels: k = clamp(1 - floor(log_b x)). Two
sketches merge by taking the larger of each register. Registers of similar sets
agree, so bands of them collect candidates; the likelihood of the three counts of
registers (larger, smaller, equal), jointly with both set sizes, estimates a
candidate pair's similarity; the pairs left are verified on their full sets.

Work is bounded as follows. Documents with the same words are one class from the
start, and only one of them goes on. Within a band's bucket every member is
compared with the bucket's first, not with all others. Pairs are handled in groups
of one hub document and its partners, dealt in salted parts. A large bucket whose
members are in different components after that tries its most central member as
the hub. For members in different components even then an exact prefix filter
finds the pairs left to verify: of two sets that are alike enough, the first
member they share, rarest first, leaves room for all they must share. Members
that only one component holds can't be it and are not looked at, so a group whose
common members fill its sets does not meet in them.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store, few, free_name, kept_in_worker, slices, stage, unstage

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE, RATE, LAST = 1.001, 20.0, 65534
SALT, BLOCK, WIDE, PIVOT_ROUNDS = 256, 512, 32, 3
CELL, PART, CELLS = 1.05, 4096, 64
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
_RNG = np.random.Generator(np.random.PCG64(5))
FACTOR = _RNG.integers(0, 2**63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _RNG.integers(0, 2**63, REGISTERS, np.uint64)


def word_hash(word: str) -> int:
    """64-bit hash of a word with A-Z lower-cased."""
    import xxhash

    return xxhash.xxh3_64_intdigest(word.translate(LOWER).encode("utf-8", "surrogatepass"))


def word_hashes(text: str | None) -> np.ndarray:
    found = WORDS.findall(text or "")
    known = kept_in_worker("setsketch", "words", lambda: Store(word_hash))
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words, given the words' hashes; of the whole, where there are fewer; none of no words."""
    if not len(h):
        return h
    width = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, width, np.uint64)
        for n in range(width):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[n : n + len(out)])
    return np.unique(out)


def sketch(members: np.ndarray) -> np.ndarray:
    """Registers of a set; of an empty one all zero."""
    if not len(members):
        return np.zeros(REGISTERS, np.uint16)
    with np.errstate(over="ignore"):
        low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(members), 1024):
            x = members[start : start + 1024, None] * FACTOR + SHIFT
            x ^= x >> np.uint64(32)
            np.minimum(low, x.min(axis=0), out=low)
    u = (low.astype(np.float64) + 1.0) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 2.0**-53)) / RATE
    return np.clip(1 - np.floor(np.log(x) / math.log(BASE)), 0, LAST).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


GRID = np.linspace(0.0, 1.0, 401)


def estimate(a: np.ndarray, n_a: int, b: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of one sketch with each row of ``b``.

    With shares u and v of the two sizes in their sum and similarity j, a register
    of the first is larger with probability p(u - v j), smaller with p(v - u j),
    and equal otherwise, where p(x) = -log_b(1 - x (b - 1) / b).
    """
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = REGISTERS - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    first, second = p(u - v * GRID), p(v - u * GRID)
    tiny = 1e-12
    score = more[:, None] * np.log(first + tiny) + less[:, None] * np.log(second + tiny) + same[:, None] * np.log(np.maximum(1 - first - second, 0) + tiny)
    score = np.where(GRID <= np.minimum(u / v, v / u) + 1e-9, score, -np.inf)
    return GRID[np.argmax(score, axis=1)]


def with_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written table: row (an identity of each row), doc_id, text."""
    return stage(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "rows")


def profile(rows: DataFrame, size: int) -> DataFrame:
    """Written table: row, doc_id, words_key (what documents with the same words share), n_shingles, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, counts, regs = [], [], []
                for text in part.column(2).to_pylist():
                    h = word_hashes(text)
                    members = shingles(h, size)
                    keys.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest())
                    counts.append(len(members))
                    regs.append(sketch(members).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(regs, pa.binary())], names=["row", "doc_id", "words_key", "n_shingles", "registers"])

    return stage(rows.select("row", "doc_id", "text").mapInArrow(run, "row long, doc_id long, words_key binary, n_shingles long, registers binary"), "profile")


def bands(classes: DataFrame) -> DataFrame:
    """bucket (band and hash of its registers), rep: a row for each band of each class."""
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * width + 1, width)))
    return classes.select(F.explode(keys).alias("bucket"), "rep")


def against_hubs(pairs: DataFrame, payload: DataFrame, keep: Callable[[tuple, list[tuple]], list[bool]]) -> DataFrame:
    """Pairs (hub, rep) for which ``keep`` holds; payload: rep, n, data.

    Each partner's data moves once a pair, a hub's once for each of its salts.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALT)))
    # A hub with few partners is not worth salting.
    many = pairs.groupBy("hub").count().select(F.col("hub").alias("big"), F.greatest(F.lit(1), F.least(F.lit(SALT), F.floor(F.col("count") / 64))).alias("salts"))
    salted = salted.join(many, salted["hub"] == many["big"]).withColumn("salt", F.pmod("salt", "salts")).select("hub", "salt", "rep")
    hubs = salted.select("hub", "salt").distinct().withColumn("rep", F.col("hub")).withColumn("is_hub", F.lit(0))
    sides = hubs.unionByName(salted.withColumn("is_hub", F.lit(1)))
    data = payload.select(F.col("rep").alias("r"), "n", "data")
    rows = sides.join(data, sides["rep"] == data["r"]).select("hub", "salt", "is_hub", "rep", "n", "data")
    dealt = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "is_hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            for part in slices(batch):
                out: list[tuple[int, int]] = []
                same: list[tuple] = []

                def flush():
                    if same:
                        out.extend((hub[0], r[0]) for r, good in zip(same, keep(hub, same)) if good)
                        same.clear()

                for h, is_hub, rep, n, data in zip(*(part.column(c).to_pylist() for c in (0, 2, 3, 4, 5))):
                    if not is_hub:
                        flush()
                        hub = (h, n, data)
                    else:
                        same.append((rep, n, data))
                flush()
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["hub", "rep"])

    return dealt.mapInArrow(run, "hub long, rep long")


def likely(least: float) -> Callable[[tuple, list[tuple]], list[bool]]:
    """Estimate at least ``least``, which is well below the threshold, and sizes that allow it."""

    def keep(hub, rows):
        a = np.frombuffer(hub[2], np.uint16)
        b = np.frombuffer(b"".join(r[2] for r in rows), np.uint16).reshape(len(rows), -1)
        n = np.array([r[1] for r in rows], np.float64)
        return list(estimate(a, float(hub[1]), b, n) >= least)

    return keep


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    n = int((both[1:] == both[:-1]).sum())
    return 100 * n >= percent * (len(a) + len(b) - n)


def verified(percent: int) -> Callable[[tuple, list[tuple]], list[bool]]:
    """Whether pairs are linked, on the full sets."""

    def keep(hub, rows):
        a = np.frombuffer(hub[2], np.uint64)
        return [linked(a, np.frombuffer(data, np.uint64), percent) for _, _, data in rows]

    return keep


def full_sets(rows: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """rep, n, data (the sorted set) for the rows that ``reps`` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(word_hashes(t), size) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["rep", "n", "data"])

    wanted = few(reps.select(F.col("rep").alias("w")).distinct(), "wanted")
    return rows.join(wanted, F.col("row") == F.col("w"), "left_semi").select(F.col("row").alias("rep"), "text").mapInArrow(run, "rep long, n long, data binary")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node that edges (hub, rep) lead to), for nodes with edges.

    Large-star and small-star steps alternate until nothing changes; each round's
    edges are written, and only a count and a check sum reach the driver.
    """
    both = lambda e: e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = stage(edges.select(F.greatest("hub", "rep").alias("u"), F.least("hub", "rep").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    while True:
        near = both(now)
        least = near.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        # No more rows than edges, so equal ones wait for the end of the round.
        large = near.join(least, near["u"] == least["k"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        small = large.join(least, large["u"] == least["k"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        after = stage(small.filter("u <> v").distinct(), "edges")
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        unstage(now)
        now = after
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark


def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """bucket, size, held (rep and component of a part of its members): buckets whose members, without the first, are in several components.

    Members go in at most CELLS parts a bucket, and a part is one row, so what
    decides on a bucket meets few rows of a large one, and none is gathered whole.
    """
    labelled = members.filter("rep <> first").join(labels, F.col("rep") == F.col("node"), "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    least, most = F.min("component").alias("lo"), F.max("component").alias("hi")
    cells = labelled.groupBy("bucket", F.pmod(F.xxhash64("rep"), F.lit(CELLS)).alias("cell")).agg(F.collect_list(F.struct("rep", "component")).alias("held"), least, most)
    cells = stage(cells.drop("cell"), "cells")
    spread = cells.groupBy(F.col("bucket").alias("b")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum(F.size("held")).alias("size")).filter("lo <> hi").select("b", "size")
    return cells.join(spread, F.col("bucket") == F.col("b")).select("bucket", "size", "held")


def each_member(rows: DataFrame) -> DataFrame:
    """bucket, size, rep, component: a row for each member that ``open_buckets`` holds."""
    return rows.select("bucket", "size", F.explode("held").alias("x")).select("bucket", "size", "x.rep", "x.component")


def pivots(rows: DataFrame, classes: DataFrame, tried: DataFrame) -> DataFrame:
    """hub, rep: in each open bucket of more than WIDE members the most central one that isn't in ``tried`` (hub), with those of other components.

    Each block of a bucket names the member with the most registers in common
    with the rest of the block, and the best of these is the bucket's: as many
    pairs as members.
    """
    wide = each_member(rows.filter(F.col("size") > WIDE))
    data = classes.select(F.col("rep").alias("r"), F.col("registers").alias("data"))
    old = tried.select(F.col("hub").alias("old")).distinct()
    placed = wide.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "rep"), F.ceil(F.col("size") / BLOCK))).join(data, F.col("rep") == F.col("r")).join(old, F.col("rep") == F.col("old"), "left")
    dealt = placed.select("bucket", "block", "rep", "component", "data", F.col("old").isNull().alias("new")).repartition("bucket", "block").sortWithinPartitions("bucket", "block", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, _), held in grouped(batches, 2):
            regs = np.frombuffer(b"".join(r[2] for r in held), np.uint16).reshape(len(held), -1)
            score = [float((regs == r).mean()) if x[3] else -1.0 for r, x in zip(regs, held)]
            best = int(np.argmax(score))
            if score[best] >= 0:
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([held[best][0]], pa.int64()), pa.array([held[best][1]], pa.int64()), pa.array([score[best]], pa.float64())], names=["bucket", "rep", "own", "score"])

    best = dealt.mapInArrow(run, "bucket long, rep long, own long, score double").groupBy(F.col("bucket").alias("p_bucket")).agg(F.max(F.struct("score", "rep", "own")).alias("x")).select("p_bucket", F.col("x.rep").alias("hub"), F.col("x.own").alias("own"))
    met = rows.join(best, F.col("bucket") == F.col("p_bucket")).select("hub", "own", F.explode("held").alias("x"))
    return met.filter("x.component <> own").select("hub", "x.rep").distinct()


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, rows) of consecutive rows with the same first ``keys`` columns; the rows without them."""
    key, held = None, []
    for batch in batches:
        for part in slices(batch):
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if row[:keys] != key:
                    if held:
                        yield key, held
                    key, held = row[:keys], []
                held.append(row[keys:])
    if held:
        yield key, held


def tokens(sets: DataFrame) -> DataFrame:
    """token, rep, component, n: a row for each member of each set of (rep, component, n, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data = part.column(3).to_pylist()
                each = np.array([len(d) // 8 for d in data])
                members = np.frombuffer(b"".join(data), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(members), *(pa.array(np.repeat(np.asarray(part.column(k)), each)) for k in range(3))], names=["token", "rep", "component", "n"])

    return sets.select("rep", "component", "n", "data").mapInArrow(run, "token long, rep long, component long, n long")


def prefix_rows(sets: DataFrame, percent: int) -> DataFrame:
    """Written table: token, a, b, side, rep, component, n, left: where two sets of different components may first meet.

    A token that one component alone holds is in no link that joins components.
    Of the others a set's are ordered, rarest first, and ``left`` counts those from
    this one on. Sets of n and m members that are linked share at least
    percent (n + m) / (100 + percent) tokens, so the first they share leaves as
    many on both sides; that bounds the m that a token is of use for. Sizes are
    dealt in cells of CELL, and a row goes to each pair of cells (a, b) that its
    own cell and a partner's can form. Pairs of cells without two components drop out.
    """
    each = tokens(sets)
    mixed = each.groupBy(F.col("token").alias("t")).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("df")).filter("lo <> hi").select("t", "df")
    held = each.join(mixed, F.col("token") == F.col("t")).groupBy("rep", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("by"))
    held = held.filter(100 * F.size("by") >= percent * F.col("n"))
    placed = held.select("rep", "component", "n", F.size("by").alias("k"), F.posexplode("by").alias("at", "x")).select("rep", "component", "n", F.col("x.token").alias("token"), (F.col("k") - F.col("at")).cast("long").alias("left"))
    least = F.ceil(percent * F.col("n") / 100)
    most = F.least(F.floor(100 * F.col("n") / percent), F.floor(F.col("left") * (100 + percent) / percent - F.col("n") + 1e-6))
    cell = lambda x: F.floor(F.log(x.cast("double")) / math.log(CELL))
    near = placed.withColumn("own", cell(F.col("n"))).withColumn("least", least).withColumn("most", most).filter("most >= least")
    near = near.withColumn("other", F.explode(F.sequence(cell(F.col("least")), cell(F.col("most")))))
    near = near.select("token", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "component", "n", "left")
    near = stage(near, "prefixes")
    key = ["token", "a", "b"]
    spread = near.groupBy(*key).agg(*(f(c).alias(f"{w}_{c}") for c in ("component", "side") for w, f in (("lo", F.min), ("hi", F.max))))
    spread = spread.filter("lo_component <> hi_component AND (a = b OR lo_side <> hi_side)").select(*(F.col(c).alias(f"k_{c}") for c in key))
    return stage(near.join(spread, [F.col(c) == F.col(f"k_{c}") for c in key]).select(*near.columns), "prefixes")


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """hub, rep: pairs of different components that can first meet in a token, each once.

    Of a token's rows those outside its largest component are compared with all,
    so the rows of that component don't meet one another. All are dealt in parts
    of PART rows, and the few outside go to each part.
    """
    key = ["token", "a", "b"]
    named = [F.col(c).alias(f"k_{c}") for c in key]
    most = rows.groupBy(*key, "component").agg(F.count(F.lit(1)).alias("n")).groupBy(*named).agg(F.max(F.struct("n", "component"))["component"].alias("main"), F.ceil(F.sum("n") / PART).alias("parts"))
    rows = rows.join(most, [F.col(c) == F.col(f"k_{c}") for c in key]).select(*rows.columns, "main", "parts")
    fields = ("side", "rep", "component", "n", "left")
    one = rows.filter("component <> main").select(*key, F.explode(F.sequence(F.lit(1).cast("long"), "parts")).alias("part"), *(F.col(c).alias(f"x_{c}") for c in fields))
    two = rows.select(*key, (F.pmod(F.xxhash64("rep"), "parts") + 1).alias("part"), "main", *(F.col(c).alias(f"y_{c}") for c in fields))
    cells = (F.col("a") == F.col("b")) | (F.col("x_side") != F.col("y_side"))
    order = (F.col("y_component") == F.col("main")) | (F.col("x_rep") < F.col("y_rep"))
    sizes = 100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n")
    room = (100 + percent) * F.least("x_left", "y_left") >= percent * (F.col("x_n") + F.col("y_n"))
    met = one.join(two, [*key, "part"]).filter(cells & order & sizes & room & (F.col("x_component") != F.col("y_component")))
    return met.select(F.col("x_rep").alias("hub"), F.col("y_rep").alias("rep")).distinct()


def links(rows: DataFrame, pairs: DataFrame, sketches: DataFrame, size: int, percent: int) -> DataFrame:
    """Written table: the pairs (hub, rep) that are likely by their sketches and linked by their full sets."""
    s = percent / 100
    least = s - 4 * math.sqrt(s * (1 - s) / REGISTERS)
    near = stage(against_hubs(pairs, sketches, likely(least)), "candidates")
    either = near.select(F.col("hub").alias("rep")).unionByName(near.select("rep"))
    out = stage(against_hubs(near, full_sets(rows, either, size), verified(percent)), "links")
    unstage(near)
    return out


def grouped_rows(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """row, doc_id, n_shingles, component (a number that the rows of a group share; null for an empty set) of written (row, doc_id, text)."""
    docs = profile(rows, size)
    classes = stage(docs.filter("n_shingles > 0").groupBy("words_key").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n_shingles"), F.min("registers").alias("registers")), "classes")
    wide = bands(classes)
    first = wide.groupBy(F.col("bucket").alias("b")).agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first <> last").select("b", "first")
    members = stage(wide.join(first, wide["bucket"] == first["b"]).select("bucket", "rep", "first"), "members")
    sketches = classes.select("rep", F.col("n_shingles").alias("n"), F.col("registers").alias("data"))
    hubs = members.filter("rep <> first").select(F.col("first").alias("hub"), "rep").distinct()
    found = links(rows, hubs, sketches, size, percent)
    labels, tried = stage(components(found), "labels"), hubs.select("hub").distinct()
    opened = stage(open_buckets(members, labels), "open")
    for _ in range(PIVOT_ROUNDS):  # large buckets first get a better hub than their first member
        central = stage(pivots(opened, classes, tried), "pivots")
        if central.isEmpty():
            break
        more = links(rows, central, sketches, size, percent)
        if more.isEmpty():
            break
        found, tried = found.unionByName(more), tried.unionByName(central.select("hub").distinct())
        labels = stage(components(found), "labels")
        opened = stage(open_buckets(members, labels), "open")
    rest = stage(each_member(opened).select("rep", "component").distinct(), "rest")
    if not rest.isEmpty():
        sets = full_sets(rows, rest, size).withColumnRenamed("rep", "r")
        sets = stage(sets.join(rest, F.col("r") == F.col("rep")).select("rep", "component", "n", "data"), "sets")
        more = links(rows, prefix_pairs(prefix_rows(sets, percent), percent), sketches, size, percent)
        if not more.isEmpty():
            labels = stage(components(found.unionByName(more)), "labels")
    # A row alone in its class and component is its own component, and needs no partner in the last join.
    labelled = classes.join(labels, F.col("rep") == F.col("node"), "left").filter("copies > 1 OR component IS NOT NULL")
    labelled = few(labelled.select(F.col("words_key").alias("k"), F.coalesce("component", "rep").alias("component")), "labelled")
    own = F.when(F.col("n_shingles") > 0, F.col("row"))
    return docs.select("row", "doc_id", "n_shingles", "words_key").join(labelled, F.col("words_key") == F.col("k"), "left").select("row", "doc_id", "n_shingles", F.coalesce("component", own).alias("component"))


def near_groups(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets' intersection is at least ``percent`` per
    cent of the union; component_id is the least id that links lead to. Null and
    empty texts have empty sets and are linked with nothing. Each row stands for
    itself: rows that repeat an id are linked by their texts alone. Rows with a
    null id never name a group; one of null ids alone has a null component_id, and
    its rows are kept. An empty table gives no rows; other columns are not read.

    A pair of similarity s shares a band with probability 1 - (1 - s^5)^32:
    0.999997 at 0.8. Candidates are dropped when they are estimated below the
    threshold less four standard deviations.
    """
    out = stage(grouped_rows(with_rows(df, id_col, text_col), size, percent), "groups")
    least = out.filter("component IS NOT NULL").groupBy(F.col("component").alias("c")).agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("c", "component_id")
    named = out.join(few(least, "least"), F.col("component") == F.col("c"), "left")
    named = named.select("doc_id", "n_shingles", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(df: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` of each group of near copies, with all its columns: the one with the least id, nulls last.

    Exactly one row of a group stays, also where ids repeat or are null. Rows with
    empty sets all stay. An empty table gives no rows.
    """
    own = free_name(df, "own_row")
    held = stage(df.withColumn(own, F.monotonically_increasing_id()), "held")
    rows = held.select(F.col(own).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = stage(grouped_rows(rows, size, percent), "groups")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = out.filter("component IS NOT NULL").groupBy(F.col("component").alias("c")).agg(F.min(place)["row"].alias("stays"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    gone = out.join(few(first, "first"), F.col("component") == F.col("c")).filter("row <> stays").select(F.col("row").alias(own))
    return held.join(few(gone, "gone"), own, "left_anti").select(*df.columns)
