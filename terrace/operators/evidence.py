"""Evidence and reading briefs: bounded unions of facts with where they come from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_words
from .relational import greedy_prefix, top_k, union_all

#: How many items, and how facts are ordered by how far they can be relied on.
MAX_ITEMS, MAX_DOCUMENTS, MAX_COMMITS, WINDOW_DAYS, MAX_DETAIL = 24, 6, 5, 90, 400
RELIABILITY = ("role", "calls", "called-by", "tested-by", "history", "comment")
FACT_LIMITS = {"calls": 8, "called-by": 8, "tested-by": 4}
#: How far a fact can be relied on, the most first, and the kinds of facts in order.
RELIABLE = ("current", "test", "dated-history", "comment-current", "comment-older-than-code", "comment-age-unknown")
KINDS = ("role", "calls", "called-by", "uncommitted", "test-states", "commit", "comment")
MAX_SUBTESTS = 6
FACT = ("node", "kind", "n", "text", "reliability", "date", "other", "source")
TOKEN_EDGE = r"[^\p{L}\p{Nd}_./-]+"


def collect_evidence(items: DataFrame, indexed: DataFrame, most: int = MAX_ITEMS) -> DataFrame:
    """node, rank, provider_ord, ord, path: the first items of each node by provider and order, of indexed paths only; a null path needs no index."""
    known = items.join(indexed.select(F.col("path").alias("known")), F.col("path") == F.col("known"), "left").filter("path IS NULL OR known IS NOT NULL").drop("known")
    return top_k(known, ["node"], [F.col("provider_ord"), F.col("ord")], most, "rank")


def document_references(documents: DataFrame, terms: DataFrame, most: int = MAX_DOCUMENTS) -> DataFrame:
    """term, path, line, text: the first line of each document with ``term`` as a whole token, cut to MAX_DETAIL bytes; the first documents by path.

    Lines are cut into tokens once and met with all terms by an equi join.
    """
    lines = documents.select("path", F.posexplode(F.split("source", "\n", -1)).alias("n", "text"))
    tokens = lines.select("path", (F.col("n") + 1).alias("line"), F.explode(F.array_distinct(F.split("text", TOKEN_EDGE))).alias("token")).filter("token <> ''")
    hits = tokens.join(terms.select(F.col("term").alias("token")).distinct(), "token").groupBy(F.col("token").alias("term"), "path").agg(F.min("line").alias("line"))
    first = top_k(hits, ["term"], [F.col("path")], most, "n").drop("n")
    return first.join(lines.select("path", (F.col("n") + 1).alias("line"), "text"), ["path", "line"]).select("term", "path", "line", within_bytes(F.col("text"), MAX_DETAIL).alias("text"))


def within_bytes(text: Column, most: int) -> Column:
    """As many whole characters from the start as fit in ``most`` bytes."""
    fits = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(most)), lambda k: F.octet_length(F.left(text, k)) <= most))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.left(text, fits))


def history(log: DataFrame, key: str, now, k: int = MAX_COMMITS, days: int = WINDOW_DAYS) -> tuple[DataFrame, DataFrame]:
    """(key, n, commit, day) of the newest ``k`` commits, and (key, churn), the commits of the last ``days``; log: key, commit, ts."""
    newest = top_k(log, [key], [F.col("ts").desc(), F.col("commit")], k, "n").select(key, "n", "commit", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    churn = log.groupBy(key).agg(F.count_if(F.col("ts") >= now - F.expr(f"INTERVAL {days} DAYS")).alias("churn"))
    return newest, churn


def evidence_text(items: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Items in (provider, label) order while their lines fit into ``limit`` bytes; stops at the first that doesn't."""
    return greedy_prefix(items, keys, [F.concat("provider", "label"), F.col("ord")], F.octet_length("line"), limit)


def first_others(df: DataFrame, k: int) -> DataFrame:
    """node, n, other: the first ``k`` distinct others of each node; equal rows share a rank, so they fall together where they are ranked and need no shuffle of their own."""
    ranked = df.withColumn("n", F.dense_rank().over(Window.partitionBy("node").orderBy("other"))).filter(F.col("n") <= k)
    return ranked.groupBy("node", "n", "other").agg(F.count(F.lit(1)).alias("times")).drop("times")


def relation_facts(nodes: DataFrame, edges: DataFrame, name: Callable[[str], Column] = F.col) -> DataFrame:
    """node, kind, n, other: roles, calls, callers and tests, each cut to its limit; a caller that is a test is told once, as a test.

    ``name`` gives the id of a column, where nodes and edges go by keys; node stays a key.
    """
    roles = nodes.select(F.col("id").alias("node"), F.posexplode(F.array_sort("roles")).alias("n", "other")).select("node", F.lit("role").alias("kind"), (F.col("n") + 1).alias("n"), "other")
    calls = edges.filter(F.col("kind").isin("calls", "local-module-source", "route-to-handler")).select(F.col("src").alias("node"), name("dst").alias("other"))
    tests = edges.filter("kind = 'tested-by'").select(F.col("src").alias("node"), name("dst").alias("other"))
    calls, told = first_others(calls, FACT_LIMITS["calls"]), first_others(tests, FACT_LIMITS["tested-by"])
    # Tests that are told take the place of as many callers at most, so that many more callers are enough; all three are in place by node.
    callers = first_others(edges.filter("kind = 'calls'").select(F.col("dst").alias("node"), name("src").alias("other")), FACT_LIMITS["called-by"] + FACT_LIMITS["tested-by"])
    known = told.groupBy(F.col("node").alias("k")).agg(F.collect_list("other").alias("known"))
    callers = callers.join(known, F.col("node") == F.col("k"), "left").filter(~F.coalesce(F.array_contains("known", F.col("other")), F.lit(False)))
    callers = top_k(callers.select("node", "other"), ["node"], [F.col("other")], FACT_LIMITS["called-by"], "n")
    cut = [df.select("node", F.lit(kind).alias("kind"), "n", "other") for kind, df in (("calls", calls), ("called-by", callers), ("tested-by", told))]
    return union_all([roles.withColumn("n", F.col("n").cast("int")), *cut])


def brief(facts: DataFrame) -> DataFrame:
    """facts with ``place``, their order by reliability and then their own, within each node."""
    rank = F.array_position(F.array(*map(F.lit, RELIABILITY)), F.col("kind"))
    return facts.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(rank, "n", "other")))


def brief_text(facts: DataFrame, limit: int) -> DataFrame:
    """node, text: a node's facts as JSON, without the least reliable ones, until the text fits into ``limit`` bytes."""
    row = F.to_json(F.struct("kind", "other"))
    w = Window.partitionBy("node").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sized = facts.withColumn("row", row).withColumn("size", F.sum(F.octet_length("row") + 1).over(w) + 1)
    fits = sized.groupBy("node").agg(F.array_sort(F.collect_list(F.when(F.col("size") <= limit, F.struct("place", "row")))).alias("rows"))  # nodes without any keep an empty list
    return fits.select("node", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]")).alias("text"))


def test_statement(name: Column, source: Column) -> Column:
    """A test's name in words, and its first named subtests; a null source has none."""
    words = split_words(F.regexp_replace(F.regexp_replace(name, r"^.* ", ""), "^Test", ""))
    found = F.slice(F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(r't\.Run\(\s*"([^"\\]{1,120})"'), F.lit(1)), 1, MAX_SUBTESTS)
    return F.concat(words, F.when(F.size(found) > 0, F.concat(F.lit("; subtests: "), F.array_join(found, ", "))).otherwise(""))


def fact(kind: Column | str, reliability: Column | str, **columns: Column) -> list[Column]:
    """The columns of a fact; those that aren't given are empty, ``n`` is 1."""
    given = {"kind": F.lit(kind), "reliability": F.lit(reliability), "n": F.lit(1), "node": F.col("node")} | columns
    return [given.get(c, F.lit("")).cast("int" if c == "n" else "string").alias(c) for c in FACT]


def rated(comment_ts: Column, code_ts: Column) -> Column:
    """How far a comment can be relied on, by when it and the code below last changed."""
    return F.when(comment_ts.isNull() | code_ts.isNull(), RELIABLE[5]).when(code_ts > comment_ts, RELIABLE[4]).otherwise(RELIABLE[3])


def reading_brief(facts: DataFrame) -> DataFrame:
    """facts with ``place``, from the most reliable on, within each node; texts are cut to their limit.

    A node has few facts, each kind being cut before; an unknown reliability or kind comes last.
    """
    rank = lambda names, c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0)), F.lit(len(names) + 1))
    w = Window.partitionBy("node").orderBy(rank(RELIABLE, "reliability"), rank(KINDS, "kind"), "n", "text")
    return facts.withColumn("text", F.substring("text", 1, MAX_DETAIL)).withColumn("place", F.row_number().over(w))


def reading_text(facts: DataFrame, units: DataFrame, limit: int) -> DataFrame:
    """node, text: unit, path and facts as JSON, without the least reliable facts, until the text fits into ``limit`` bytes; units: node, unit, path.

    The text without facts is given even where it doesn't fit. Empty dates are left out.
    """
    row = F.to_json(F.struct("kind", "text", "reliability", F.nullif("date", F.lit("")).alias("date"), "source"))
    head = F.to_json(F.struct("unit", "path"))
    opened = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"facts":['))
    w = Window.partitionBy("node").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sized = facts.join(units.withColumn("head", head).select("node", opened.alias("opened")), "node").withColumn("row", row).withColumn("size", F.octet_length("opened") + 1 + F.sum(F.octet_length("row") + 1).over(w))
    fits = sized.filter(F.col("size") <= limit).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "row"))).alias("rows"))
    rows = F.coalesce(F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit(""))
    return units.withColumn("head", head).join(fits, "node", "left").select("node", F.concat(opened, rows, F.lit("]}")).alias("text"))


def nearest_line(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """unit, line: of the lines with a unit's first line as text, the nearest to where it starts, the earlier of two; wanted: unit, path, text, start."""
    hits = wanted.join(lines, ["path", "text"])
    return hits.groupBy("unit").agg(F.min_by("line", F.struct(F.abs(F.col("line") - F.col("start")).alias("far"), "line")).alias("line"))


def comment_spans(lines: DataFrame, units: DataFrame) -> DataFrame:
    """unit, path, from, to: where the unbroken comment lines just above a unit stand; a shebang ends them. lines: path, line, text; units: unit, path, start."""
    trimmed = F.trim(F.col("text"))
    is_comment = trimmed.rlike(r"^(//|#)") & ~trimmed.startswith("#!")
    w = Window.partitionBy("path").orderBy("line")
    marked = lines.withColumn("comment", is_comment).withColumn("last_code", F.max(F.when(~F.col("comment"), F.col("line"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    above = units.join(marked.select(F.col("path").alias("l_path"), F.col("line").alias("above"), "last_code"), (F.col("path") == F.col("l_path")) & (F.col("start") - 1 == F.col("above")))
    return above.select("unit", "path", (F.coalesce("last_code", F.lit(0)) + 1).alias("from"), (F.col("start") - 1).alias("to")).filter(F.col("from") <= F.col("to"))


def leading_comments(lines: DataFrame, units: DataFrame) -> DataFrame:
    """unit, n_lines, text: the comment just above a unit, without tool directives; lines: path, line, text; units: unit, path, start."""
    trimmed, spans = F.trim(F.col("text")), comment_spans(lines, units)
    body = lines.select(F.col("path").alias("b_path"), F.col("line").alias("b_line"), trimmed.alias("b_text"))
    joined = spans.join(body, (F.col("path") == F.col("b_path")) & F.col("b_line").between(F.col("from"), F.col("to")))
    words = joined.filter(~F.col("b_text").rlike(r"^(//(go:|line )|// ?(nolint|lint:)|# ?(noqa|type:|pylint:|shellcheck ))"))
    return words.groupBy("unit").agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b_line", "b_text"))), lambda x: F.trim(F.regexp_replace(x["b_text"], r"^(//+|#+)", ""))), " ").alias("text"))


def comment_age(blame: DataFrame) -> DataFrame:
    """unit, comment_ts, code_ts, stale: a comment is stale if its newest line is older than the newest line of code; blame: unit, is_comment, ts."""
    newest = blame.groupBy("unit").agg(F.max(F.when(F.col("is_comment"), F.col("ts"))).alias("comment_ts"), F.max(F.when(~F.col("is_comment"), F.col("ts"))).alias("code_ts"))
    return newest.filter("comment_ts IS NOT NULL").withColumn("stale", F.coalesce(F.col("code_ts") > F.col("comment_ts"), F.lit(False)))
