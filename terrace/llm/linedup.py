"""Repeated runs of lines, by a suffix array over line-ID sequences.

1. Lines become identifiers. Lines that occur once can be part of no repeated
   run; they end runs as a document's end does, and only the suffixes that start
   with a repeated line go on.
2. Prefix doubling. Suffixes carry a rank, the place of their group in the suffix
   array so far. A round pairs each rank with that of the suffix 2^k lines on and
   ranks the pairs. Pairs are counted before they are sorted by range, so equal
   ones are one row however often they occur; ranks come from prefix sums over
   the ranges' totals. A suffix alone in its group has its final rank and goes
   through no further round.
3. Longest common prefixes. The round in which two neighbours of the suffix array
   parted gives the power of two in their common prefix, and the ranks of lower
   rounds the rest, for the few pairs that have any.
4. Intervals. Neighbours with a common prefix of at least MIN_LINES form an
   interval: the places where one run starts. All but its first place, in the
   order of documents, are later copies, and their lines are deleted. The lines
   deleted for neighbouring places merge into whole maximal runs.
5. Long lines. A line of at least LONG_LINE words is a passage of its own: its
   group in the first ranks is an interval as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, slices, stage, unstage

MIN_LINES = 2
#: Words from which a single line that stands earlier too is deleted.
LONG_LINE = 50


def running(df: DataFrame, keys: list[str], amount: str, group: str) -> DataFrame:
    """Written table: ``df`` with ``before``, the sum of ``amount`` over earlier rows, and ``group_before``, that at the first row with the same ``group``.

    Rows are ordered by ``keys``, of which ``group`` is the first. Each range of
    rows is summed by its own task; one row a range goes through the driver.
    """
    # What is counted before has far fewer rows than the lines, and a task streams them: a quarter of the usual ranges will do.
    dealt = df.repartitionByRange(max(1, shuffle_width(df.sparkSession) // 4), *keys).sortWithinPartitions(*keys)
    names = [*df.columns, "part", "before", "group_before"]
    at, of = df.columns.index(amount), df.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total, last, start, first = TaskContext.get().partitionId(), 0, None, 0, None
        for batch in batches:
            n = np.asarray(batch.column(at), np.int64)
            g = np.asarray(batch.column(of), np.int64)
            if not len(n):
                continue
            before = total + np.cumsum(n) - n
            new = np.ones(len(g), bool)
            new[1:] = g[1:] != g[:-1]
            new[0] = last is None or g[0] != last
            first = int(g[0]) if first is None else first
            starts = np.where(new, before, -1)
            starts[0] = before[0] if new[0] else start
            starts = np.maximum.accumulate(starts)
            # A group that goes on from an earlier range is marked; its start is not known here.
            marked = np.where(g == first, -1, starts)
            total, last, start = int(before[-1] + n[-1]), int(g[-1]), int(starts[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int64)), pa.array(before), pa.array(marked)], names=names)

    from pyspark.sql.types import LongType, StructType

    schema = StructType(df.schema.fields.copy())
    for c in ("part", "before", "group_before"):
        schema.add(c, LongType())
    summed = stage(dealt.mapInArrow(run, schema), "running")
    ranges = summed.groupBy("part").agg(F.sum(amount).alias("total"), F.min(group).alias("first"), F.max(group).alias("last"), F.max("group_before").alias("tail")).orderBy("part").collect()
    shift, offsets, last, open_at = 0, [], None, 0
    for r in ranges:
        carried = open_at if r["first"] == last else shift
        offsets.append((r["part"], shift, carried))
        if r["last"] != r["first"]:
            open_at = shift + r["tail"]
        elif r["first"] != last:
            open_at = shift
        last = r["last"]
        shift += r["total"]
    table = df.sparkSession.createDataFrame(offsets, "p int, shift long, carried long")
    out = summed.join(F.broadcast(table), F.col("part") == F.col("p"))
    return out.select(*df.columns, (F.col("before") + F.col("shift")).alias("before"), F.when(F.col("group_before") < 0, F.col("carried")).otherwise(F.col("group_before") + F.col("shift")).alias("group_before"))


def numbered(df: DataFrame, id_col: str, text_col: str, words: int | None = None) -> DataFrame:
    """Written table: row (an identity for each row, in no order), doc_id, text, lines (identifier of each line, and whether it has ``words`` words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # Lines of fewer bytes can't hold as many words, and need no count.
    long = (lambda s: (F.octet_length(s) >= 2 * words - 1) & (word_count(s) >= words)) if words else (lambda s: F.lit(False))
    return stage(rows.withColumn("lines", F.transform(F.split("text", "\n", -1), lambda s: F.struct(F.unhex(F.sha2(s, 256)).alias("id"), long(s).alias("long")))), "lines")


def first_ranks(docs: DataFrame) -> DataFrame:
    """row, at, rank, size of the suffixes that start with a repeated line; rank is the first place of the line's group."""
    lines = docs.select("row", F.posexplode("lines.id").alias("at", "line"))
    counts = lines.groupBy("line").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # The order of lines is that of their identifiers' first seven bytes, and of all where these agree.
    keyed = counts.select(F.conv(F.hex(F.substring("line", 1, 7)), 16, 10).cast("long").alias("high"), "line", "size")
    ranked = running(keyed, ["high", "line"], "size", "high").select(F.col("line").alias("known"), F.col("before").alias("rank"), "size")
    return stage(lines.join(ranked, lines["line"] == ranked["known"]).select("row", "at", "rank", "size"), "ranks")


def doubled(active: DataFrame, known: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """Ranks of the active suffixes by twice as many lines, and the new group starts (place).

    A suffix that has no ranked suffix ``step`` lines on is unlike every other
    from there, and is told apart by its own place.
    """
    on = known.select(F.col("row").alias("r"), (F.col("at") - step).alias("a"), F.col("rank").alias("next"))
    rows = active.select("row", "at", "rank").join(on, (F.col("row") == F.col("r")) & (F.col("at") == F.col("a")), "left")
    alone = F.col("next").isNull()
    rows = stage(rows.select("row", "at", "rank", "next", F.when(alone, F.col("row")).alias("own_row"), F.when(alone, F.col("at")).alias("own_at")), "pairs")
    key = ["rank", "next", "own_row", "own_at"]
    pairs = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    ranked = running(pairs, key, "size", "rank").withColumn("to", F.col("rank") + F.col("before") - F.col("group_before"))
    new = ranked.filter("next IS NOT NULL").select(*(F.col(c).alias(f"k_{c}") for c in ("rank", "next")), "to", "size")
    joined = rows.filter("next IS NOT NULL").join(new, (F.col("rank") == F.col("k_rank")) & (F.col("next") == F.col("k_next"))).select("row", "at", F.col("to").alias("rank"), "size")
    single = ranked.filter("next IS NULL").select(F.col("own_row").alias("row"), F.col("own_at").alias("at"), F.col("to").alias("rank"), "size")
    out = stage(joined.unionByName(single), "ranks")
    starts = ranked.filter("to <> rank").select(F.col("to").alias("place"))
    starts = stage(starts, "starts")
    unstage(rows)
    return out, starts


def suffix_array(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(row, at, rank) with final ranks; (place, round) where groups parted; the ranks of each round."""
    levels = [first_ranks(docs)]
    done, starts, step = [], [], 1
    active = levels[0]
    while True:
        active_now = active.filter("size > 1")
        if active_now.isEmpty():
            done.append(active)
            break
        done.append(active.filter("size = 1"))
        known = reduce(DataFrame.unionByName, [*done, active_now])
        active, parted = doubled(active_now, known, step)
        levels.append(active)
        starts.append(parted.withColumn("round", F.lit(len(levels) - 2)))
        step *= 2
    final = reduce(DataFrame.unionByName, [d.select("row", "at", "rank") for d in done])
    spark = docs.sparkSession
    parted = reduce(DataFrame.unionByName, starts) if starts else spark.createDataFrame([], "place long, round int")
    return final, parted, levels


def common_prefixes(final: DataFrame, parted: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Written table: place, lcp, the lines that the suffix there has in common with the one before; places without any are absent."""
    here = final.select(F.col("rank").alias("place"), "row", "at")
    before = final.select((F.col("rank") + 1).alias("b_place"), F.col("row").alias("b_row"), F.col("at").alias("b_at"))
    pairs = parted.join(here, "place").join(before, F.col("place") == F.col("b_place")).select("place", "round", "row", "at", "b_row", "b_at", F.expr("shiftleft(1L, round)").alias("lcp"))
    settled, rest = pairs.filter("round = 0").select("place", "lcp"), stage(pairs.filter("round > 0"), "lcp")
    for k in range(len(levels) - 3, -1, -1):  # a prefix of 2^k more lines, where the pair parted in a later round
        if rest.isEmpty():
            break
        todo, rest_after = rest.filter(F.col("round") > k), rest.filter(F.col("round") <= k)
        # Groups of one in round k are like no other suffix over 2^k lines.
        ranks = levels[k].filter("size > 1").select(F.col("row").alias("x_row"), F.col("at").alias("x_at"), F.col("rank").alias("x_rank"))
        left = todo.join(ranks, (F.col("row") == F.col("x_row")) & (F.col("at") + F.col("lcp") == F.col("x_at")), "left").withColumnRenamed("x_rank", "one").drop("x_row", "x_at")
        both = left.join(ranks, (F.col("b_row") == F.col("x_row")) & (F.col("b_at") + F.col("lcp") == F.col("x_at")), "left")
        more = F.when(F.col("one") == F.col("x_rank"), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        grown = both.withColumn("lcp", F.col("lcp") + more).select(*rest.columns)
        now = stage(grown.unionByName(rest_after), "lcp")
        unstage(rest)
        rest = now
    return stage(settled.unionByName(rest.select("place", "lcp")), "lcp")


def but_first(members: DataFrame, docs: DataFrame, lines: int) -> DataFrame:
    """row, at, lines, copies: all members (interval, row, at) but the first of each interval, by document and place."""
    order = docs.select(F.col("row").alias("d_row"), "doc_id")
    members = stage(members.join(order, F.col("row") == F.col("d_row")).select("interval", "row", "at", "doc_id"), "members")
    spot = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "at")
    first = members.groupBy(F.col("interval").alias("i")).agg(F.min(spot).alias("first"), F.count(F.lit(1)).alias("copies"))
    joined = members.join(first, F.col("interval") == F.col("i"))
    return joined.filter((F.col("row") != F.col("first.row")) | (F.col("at") != F.col("first.at"))).select("row", "at", F.lit(lines).alias("lines"), "copies")


def word_count(s: Column) -> Column:
    """Runs of what isn't ASCII white space in a line; where single blanks part them, that is told by the number of blanks."""
    blanks = F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))
    plain = ~(s.contains("  ") | s.contains("\t") | s.contains("\x0b") | s.contains("\f") | s.contains("\r"))
    ends = s.startswith(" ").cast("int") + s.endswith(" ").cast("int")
    return F.when(s == "", 0).when(plain, blanks + 1 - ends).otherwise(F.regexp_count(s, F.lit(r"[^\x20\x09-\x0D]+")))


def later_copies(docs: DataFrame, least: int = MIN_LINES, singly: bool = True) -> DataFrame:
    """row, at, lines, copies: starts of ``least`` lines, or of one long line if ``singly``, that stand earlier too, and how often they occur."""
    final, parted, levels = suffix_array(docs)
    lcp = common_prefixes(final, parted, levels)
    # A run of places with a long common prefix, and the place before it, is an interval.
    linked = lcp.filter(F.col("lcp") >= least).select("place")
    places = linked.select("place", F.lit(1).alias("joined")).unionByName(linked.select((F.col("place") - 1).alias("place"), F.lit(0).alias("joined"))).groupBy("place").agg(F.max("joined").alias("joined"))
    flagged = places.select("place", (1 - F.col("joined")).cast("long").alias("opens"))
    summed = running(flagged, ["place"], "opens", "place").select("place", (F.col("before") + F.col("opens")).alias("interval"))
    out = but_first(summed.join(final, F.col("place") == F.col("rank")).select("interval", "row", "at"), docs, least)
    if not singly:
        return out
    each = docs.select(F.col("row").alias("l_row"), F.posexplode("lines.long").alias("l_at", "long")).filter("long")
    alone = levels[0].join(each, (F.col("row") == F.col("l_row")) & (F.col("at") == F.col("l_at"))).select(F.col("rank").alias("interval"), "row", "at")
    return out.unionByName(but_first(alone, docs, 1))


def drop_repeated_runs(df: DataFrame, least: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text", words: int | None = LONG_LINE) -> DataFrame:
    """One row a document: doc_id, n_lines, n_deleted, runs, text.

    Lines are what newlines separate; a null text counts as an empty one, which
    is one empty line. A line is deleted when it belongs to ``least`` or more
    successive lines that stand earlier as well, or alone has ``words`` or more
    words (None: no line alone) and does, by document id (nulls last) and place; earlier places in the same document count, and the two may overlap.
    Empty lines are lines like others, so a short line goes with an empty one beside
    it where the pair repeats, and stays where it alone does.
    ``runs`` lists the deleted maximal runs (first line, from 0, number of lines,
    and how often their most frequent part occurs). Rows with the same id are in
    the order in which they were read. An empty table gives no rows; other columns
    are not read.
    """
    docs = numbered(df, id_col, text_col, words)
    starts = later_copies(docs, least, words is not None)
    per_row = starts.groupBy(F.col("row").alias("s_row")).agg(F.sort_array(F.collect_list(F.struct("at", "lines", "copies"))).alias("starts"))
    joined = docs.select("row", "doc_id", "text").join(per_row, F.col("row") == F.col("s_row"), "left").select("doc_id", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            totals, deleted, runs, texts = [], [], [], []
            for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                lines = text.split("\n")
                gone = np.zeros(len(lines), bool)
                spans: list[list[int]] = []
                for x in found or ():
                    if spans and x["at"] <= spans[-1][0] + spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x["at"] + x["lines"] - spans[-1][0])
                        spans[-1][2] = max(spans[-1][2], x["copies"])
                    else:
                        spans.append([x["at"], x["lines"], x["copies"]])
                for first, n, _ in spans:
                    gone[first : first + n] = True
                totals.append(len(lines))
                deleted.append(int(gone.sum()))
                runs.append([{"first": a, "lines": n, "copies": c} for a, n, c in spans])
                texts.append("\n".join(line for line, g in zip(lines, gone) if not g) if spans else text)
            kinds = pa.list_(pa.struct([("first", pa.int64()), ("lines", pa.int64()), ("copies", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(totals, pa.int64()), pa.array(deleted, pa.int64()), pa.array(runs, kinds), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_deleted", "runs", "text"])

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_deleted long, runs array<struct<first: bigint, lines: bigint, copies: bigint>>, text string")
