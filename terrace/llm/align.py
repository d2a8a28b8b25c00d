"""Alignment of the tokens of two vocabularies over the same bytes.

Each text, with a blank before it, is encoded by a byte-level vocabulary (A) and by
a piece vocabulary with byte fallback (B). The byte intervals of the B tokens are a
static sorted index; for each A token two bisections give the run of B tokens that
it overlaps. A gap between two A tokens that no B token spans bounds a group, and
every A token of a group is linked with every B token of it.

What is counted over the corpus is the number of documents that hold a pair of
ids linked. Frequent pairs are sent to every executor, up to a counted bound; the
rest meets its counts in a shuffle, where no pair is hot any more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import BROADCAST_ROWS, kept_in_worker, slices, stage

#: Bits of a pair's code that hold the B id.
B_BITS = 24
#: Links of a group, at most, that are listed one by one; a larger group is counted by its distinct ids.
LISTED = 4096
NONE = np.zeros(0, np.int64)


class PlainEncoder(bpe.Encoder):
    """Byte-level ids, with the names of special tokens as plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tok.encode_special_tokens = True
        self.special = []


class Aligner:
    """Both vocabularies and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = PlainEncoder(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: b for b, c in bpe.byte_alphabet().items()}
        self.a_bytes = [bytes(map(byte_of.__getitem__, name)) if all(c in byte_of for c in name) else name.encode() for name in self.a.names]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_size, self.b_size = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))

    @cached_property
    def spelt(self) -> list[bytes]:
        """Ids in decimal with what may follow them: A ids with a comma, then with a bar, B ids with a comma, then with a semicolon."""
        return [b"%d%s" % (n, mark) for many, marks in ((len(self.a_bytes), (b",", b"|")), (len(self.b_bytes), (b",", b";"))) for mark in marks for n in range(many)]

    def align(self, text: str | None) -> tuple[int, int, int, int, bytes, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links, groups as text, and each linked pair once with the number of its links."""
        if not text:
            return 0, 0, 0, 0, b"", NONE, NONE
        raw, a_ids, b_ids = (" " + text).encode(), np.frombuffer(self.a.plain(" " + text), "<u4").tolist(), self.b.encode(text)
        if b"".join(map(self.a_bytes.__getitem__, a_ids)) != raw or b"".join(map(self.b_bytes.__getitem__, b_ids)) != raw:
            return 0, 0, 0, 0, b"", NONE, NONE
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_first, b_first = groups(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        n_a, n_b = np.diff(a_first, append=len(a)), np.diff(b_first, append=len(b))
        codes, times = pairs(a, b, a_first, b_first, n_a, n_b)
        return len(a), len(b), len(a_first), int((n_a * n_b).sum()), self.said(a, b, a_first, b_first, n_a, n_b), codes, times

    def said(self, a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> bytes:
        """Groups as text, written token after token, each with the mark that follows it."""
        of_a, of_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        word = np.empty(len(a) + len(b), np.int64)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[a_first + n_a - 1] = len(self.a_bytes)
        mark_b[b_first + n_b - 1] = len(self.b_bytes)
        word[np.arange(len(a)) + b_first[of_a]] = a + mark_a
        word[np.arange(len(b)) + (a_first + n_a)[of_b]] = b + mark_b + 2 * len(self.a_bytes)
        return b"".join(map(self.spelt.__getitem__, word.tolist()))[:-1]


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First A and first B token of each group, from the offsets where tokens end.

    The ends of the B tokens and their starts are the index; an A token overlaps
    the B tokens from the first that ends after its start to the last that starts
    before its end. Where the run of one A token ends before that of the next begins,
    no B token spans the gap.
    """
    a_starts, b_starts = np.r_[0, a_ends[:-1]], np.r_[0, b_ends[:-1]]
    first, beyond = np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")
    new = np.r_[0, np.flatnonzero(first[1:] >= beyond[:-1]) + 1]
    return new, first[new]


def pairs(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each linked pair of ids once, as a code, and how often it is linked."""
    listed = n_a * n_b <= LISTED
    each = np.where(listed, n_b, 0).repeat(n_a)  # links of each A token
    last = np.cumsum(each)
    spot = np.arange(last[-1]) + np.repeat(b_first.repeat(n_a) - (last - each), each)
    codes, times = [np.repeat(a, each) << B_BITS | b[spot]], [np.ones(len(spot), np.int64)]
    for g in np.flatnonzero(~listed):
        (x, m), (y, n) = (np.unique(ids[first[g] : first[g] + size[g]], return_counts=True) for ids, first, size in ((a, a_first, n_a), (b, b_first, n_b)))
        codes.append((x[:, None] << B_BITS | y).ravel())
        times.append((m[:, None] * n).ravel())
    code, n = np.concatenate(codes), np.concatenate(times)
    order = np.argsort(code)
    code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    return code[first], np.add.reduceat(n, first)


#: Columns of a document's alignment, in Arrow types, after its id.
ALIGNED = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "groups_sha256": pa.string(), "codes": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}


def aligned(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = tuple(ALIGNED)) -> DataFrame:
    """The alignment of each text: counts, ``groups`` as ``a1,a2|b1;a3|b2``, its SHA-256, and linked pairs with their number of links.

    ``codes`` are ``a << 24 | b``. Texts that are null, empty, or that the tokens of
    either vocabulary don't spell have no tokens: zeros, an empty ``groups`` and an
    empty digest. Each row gives a row, whatever its id.
    """
    kinds = {"string": pa.string(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = kept_in_worker("align", f"{a_path} {b_path}", lambda: Aligner(a_path, b_path))
        for batch in batches:
            for part in slices(batch, 128):
                cols: dict[str, list] = {c: [] for c in outputs}
                for text in part.column(1).to_pylist():
                    n_a, n_b, n_groups, n_links, said, codes, times = aligner.align(text)
                    row = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": said.decode(), "groups_sha256": hashlib.sha256(said).hexdigest() if said else "", "codes": codes, "times": times}
                    for c in outputs:
                        cols[c].append(row[c])
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(cols[c], ALIGNED[c]) for c in outputs)], names=[part.schema.names[0], *outputs])

    spark_type = {kinds["string"]: "string", kinds["long"]: "long"}
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} {spark_type.get(ALIGNED[c], 'array<long>')}" for c in outputs)
    return df.select(id_col, text_col).mapInArrow(run, schema)


def pair_counts(docs: DataFrame) -> DataFrame:
    """code, n, best: the documents that hold a pair linked, and whether no pair of its A id has more."""
    counts = docs.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    a = F.shiftright("code", B_BITS).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", sent: int = BROADCAST_ROWS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``df``.

    ``n_best`` counts the links whose pair is held by as many documents as any pair
    of its A id, ``count_sum`` adds up the documents that hold the pair of each link.
    Each row counts as a document, also where ids repeat or are null. An empty table
    gives no rows. At most ``sent`` pairs go to every executor.
    """
    said = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times")
    docs = stage(aligned(df, a_path, b_path, id_col, text_col, said).withColumn("__row", F.monotonically_increasing_id()), "aligned")
    pairs = stage(pair_counts(docs), "pairs")
    links = docs.select("__row", F.explode(F.arrays_zip("codes", "times")).alias("p")).select("__row", F.col("p.codes").alias("code"), F.col("p.times").alias("times"))
    total = pairs.count()
    if total <= sent:
        met = links.join(F.broadcast(pairs), "code")
    else:
        least = pairs.agg(F.percentile_approx("n", 1 - sent / total, 10_000)).first()[0]
        frequent = pairs.filter(F.col("n") > least)
        frequent = F.broadcast(frequent) if frequent.count() <= 1.1 * sent else frequent
        known = links.join(frequent, "code", "left")
        met = known.filter("n IS NOT NULL").unionByName(known.filter("n IS NULL").select("__row", "code", "times").join(pairs.filter(F.col("n") <= least), "code"))
    sums = met.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return docs.drop("codes", "times").join(sums, "__row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
