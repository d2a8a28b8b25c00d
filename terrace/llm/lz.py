"""Document fingerprints from Lempel-Ziv phrases.

A text is split into symbols, words and other characters, and parsed as
LZ78 does: a phrase is the longest one met before and the symbol after it. The
set of phrases is what a compressor would learn from the text. Phrases are hashed
and the set is kept as a minimum-hash signature; the share of equal places of two
signatures estimates how much of their phrase sets two texts have in common.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, kept_in_worker, shuffle_width, slices

PLACES = 128
#: The key of rows without an id.
LAST = (1 << 63) - 1
#: A word with the blank after it, or any other character.
SYMBOL = re.compile(r"\w{1,32} ?|\W")
BREAK = re.compile(r"\W(?=\w*\Z)")
MASK = (1 << 61) - 1
_RNG = np.random.Generator(np.random.PCG64(11))
FACTOR = _RNG.integers(1, 2**63, PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _RNG.integers(0, 2**63, PLACES, np.uint64)


def symbol_number(symbol: str) -> int:
    """A number that depends on the symbol alone."""
    return int.from_bytes(hashlib.blake2b(symbol.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") & MASK


def parse(symbols: list[str], known: set[int], node: int = 0) -> int:
    """Add the phrases of ``symbols`` to ``known``; the unfinished phrase is returned, to go on with."""
    numbers, add = kept_in_worker("lz", "symbols", lambda: Store(symbol_number)), known.add
    for h in map(numbers.__getitem__, symbols):
        step = (node * 0x9E3779B97F4A7C15 + h) & MASK
        if step in known:
            node = step
        else:
            add(step)
            node = 0
    return node


def signature(phrases: set[int]) -> np.ndarray:
    """Minimum of each hash over the phrases, 16 bits of it; no phrases, a row of 65535."""
    if not phrases:
        return np.full(PLACES, 65535, np.uint16)
    x = np.fromiter(phrases, np.uint64, len(phrases))
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        low = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(x), 2048):
            np.minimum(low, (x[start : start + 2048, None] * FACTOR + SHIFT).min(axis=0), out=low)
        low *= np.uint64(0x94D049BB133111EB)
    return (low >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprint(text: str) -> np.ndarray:
    phrases: set[int] = set()
    parse(SYMBOL.findall(text), phrases)
    return signature(phrases)


def compare(text: str, other: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The edited text, the fingerprint of ``text`` and that of the edited text.

    The edited text is ``text`` with its last half replaced by the start of
    ``other``. Symbols that both texts start with are parsed once.
    """
    half = len(text) // 2
    kept = text[: len(text) - half]
    edited = kept + other[:half]
    # What stands before the last break of the kept part is split into the same symbols in both.
    found = BREAK.search(kept, max(0, len(kept) - 256))
    cut = found.end() if found else 0
    phrases: set[int] = set()
    node = parse(SYMBOL.findall(text[:cut]), phrases)
    rest = phrases.copy()
    parse(SYMBOL.findall(text[cut:]), phrases, node)
    parse(SYMBOL.findall(edited[cut:]), rest, node)
    return edited, signature(phrases), signature(rest)


def dealer(firsts: list[tuple[int, int]]) -> Callable[[Column, Column], Column]:
    """The range (from 0) of a row's key and hash, given the first of each range in order."""
    keys, hashes = (np.array([f[n] for f in firsts], np.int64) for n in (0, 1))

    @F.pandas_udf("int")
    def deal(key: pd.Series, code: pd.Series) -> pd.Series:
        k, h = key.to_numpy(np.int64), code.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        # Ranges that begin within one key are told apart by the hash.
        at = high - 1
        for bound in np.unique(k[high > low]):
            here = k == bound
            a, b = np.searchsorted(keys, bound, "left"), np.searchsorted(keys, bound, "right")
            at[here] = a + np.searchsorted(hashes[a:b], h[here], "right") - 1
        return pd.Series(np.maximum(at, 0).astype(np.int32))

    return deal


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """range, boundary, doc_id, text: sorted runs of rows in which each row's successor follows it.

    Ids are cut into ranges by their quantiles; an id that fills several quantiles,
    or the rows without an id, are cut by the hash of the text. A document goes to
    the task of its range, and the first of a range also to the end of the range
    before, as a boundary row. Only the first key of each range passes through the
    driver, and a range is found by bisection.
    """
    width = shuffle_width(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(LAST))).withColumn("code", F.xxhash64("text"))
    cuts = Counter(int(x) for x in rows.approxQuantile("key", [n / width for n in range(width)], 0.2 / width))
    planned = sorted((key, -(1 << 63) + n * (2**64 // times)) for key, times in cuts.items() for n in range(times))
    deal = dealer(planned or [(0, 0)])
    least = rows.groupBy(deal("key", "code").alias("range")).agg(F.min(F.struct("key", "code")).alias("first")).collect()
    firsts = sorted((r["first"]["key"], r["first"]["code"]) for r in least)  # at most as many as there are ranges
    starts = df.sparkSession.createDataFrame([(*f, n) for n, f in enumerate(firsts)], "s_key long, s_code long, s_range int")
    before = F.pmod(F.col("range") - 1, F.lit(max(1, len(firsts)))).cast("int")
    own, copy = F.struct("range", F.lit(0).alias("boundary")), F.struct(before.alias("range"), F.lit(1).alias("boundary"))
    placed = rows.withColumn("range", dealer(firsts or [(0, 0)])("key", "code"))
    # A range has one first row here, but for rows that are equal to it.
    placed = placed.join(F.broadcast(starts), (F.col("key") == F.col("s_key")) & (F.col("code") == F.col("s_code")), "left")
    placed = placed.withColumn("to", F.when(F.col("s_range").isNotNull(), F.array(own, copy)).otherwise(F.array(own)))
    dealt = placed.select(F.explode("to").alias("to"), "key", "code", "doc_id", "text").select("to.range", "to.boundary", "doc_id", "text", "key", "code")
    return dealt.repartitionById(max(1, len(firsts)), "range").sortWithinPartitions("range", "boundary", "key", "code", "text").drop("key", "code")


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, and their likeness.

    A row's next document is the one after it by id, nulls last, and among equal
    or null ids by the xxhash64 of the text; after the last comes the first, so a table of one row is followed by itself. Null
    texts count as empty; empty texts have no phrases, and two of them have
    likeness 1. Rows that repeat an id each give a row. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = waiting = None  # the row whose successor comes next; the one before it, which awaits held's fingerprint
        done: list[tuple] = []

        def emit():
            types = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=[c.split()[0] for c in COLUMNS.split(", ")])
            done.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for group, boundary, doc_id, text in zip(*(part.column(n).to_pylist() for n in range(4))):
                    if held is not None and held[0] == group:
                        edited, mine, rest = compare(held[2], text)
                        if waiting is not None:
                            done.append((*waiting[0], likeness(waiting[1], mine)))
                        waiting = (held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), mine.tobytes().hex(), rest.tobytes().hex(), likeness(mine, rest)), mine
                        if boundary:
                            done.append((*waiting[0], likeness(mine, fingerprint(text))))
                            waiting = None
                    held = None if boundary else (group, doc_id, text)
                if done:
                    yield emit()

    return with_next(df, id_col, text_col).mapInArrow(run, COLUMNS)
