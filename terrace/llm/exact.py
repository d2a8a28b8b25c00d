"""Exact duplicates by content-defined chunk recipes, in DataFrame functions alone.

1. A text, without its ASCII white space, is split into chunks whose ends depend
   on content: the first place, at least MIN_CHUNK code points on, that follows
   a boundary pattern; MAX_CHUNK bounds a chunk where there is none.
2. Chunks become identifiers (SHA-256). Each distinct chunk moves once, after
   partial aggregation, to a check that its identifier stands for one chunk only.
3. A document is then its ordered list of identifiers. Only these lists move:
   they are compared as a whole, and the row to keep is chosen for each.

If any identifier stood for two chunks, the recipes would hold the chunks
themselves, so the result never depends on a hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, few, free_name, stage

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Rows from which a group is joined in parts, and how many.
LARGE, PARTS = 1000, 16
#: A chunk may end after one of these pairs; letters of several scripts, digits and marks.
BOUNDARY = r"(?<=[aeiouáéèíóúäöüаеио0-9،。、][nrstlдрстн.!?])"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, "")


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{{MIN_CHUNK},{MAX_CHUNK}}}?{BOUNDARY}|.{{1,{MAX_CHUNK}}})"), F.lit(1))


def sha_id(chunk: Column) -> Column:
    return F.unhex(F.sha2(chunk, 256))


def ambiguous(parts: DataFrame, ident: Callable[[Column], Column]) -> bool:
    """Whether two different chunks of ``parts.recipe_text`` share an identifier."""
    each = parts.select(F.explode("recipe_text").alias("chunk")).select(ident(F.col("chunk")).alias("id"), "chunk")
    distinct = each.groupBy("id", "chunk").agg(F.lit(1).alias("one"))
    return not distinct.groupBy("id").count().filter("count > 1").isEmpty()


def recipe_groups(rows: DataFrame, ident: Callable[[Column], Column] = sha_id) -> DataFrame:
    """row, doc_id, keep_row, keep_id, group_size, text_sha256 of (row, doc_id, text); row tells rows apart."""
    text = rows.select("row", "doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"), normalised(F.col("text")).alias("body"))
    parts = text.select("row", "doc_id", "size", chunks(F.col("body")).alias("recipe_text"), F.sha2("body", 256).alias("text_sha256"))
    as_text = ambiguous(parts, ident)
    recipe = F.col("recipe_text").cast("array<binary>") if as_text else F.transform("recipe_text", ident)
    recipes = stage(parts.select("row", "doc_id", "size", "text_sha256", recipe.alias("recipe")), "recipes")
    # With a verified list, its digest is what the join deals rows by; the list itself decides.
    keyed = recipes.withColumn("deal", F.xxhash64("recipe"))
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "size", (-F.col("doc_id")).alias("first"), (-F.col("row")).alias("second")))
    groups = stage(keyed.groupBy("deal", "recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "groups")
    # The rows of a large group are dealt in parts, and the group's own row goes to each.
    large = few(groups.filter(F.col("group_size") > LARGE).select(F.col("deal").alias("l_deal")).distinct(), "large")
    parted = F.when(F.col("l_deal").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    groups = groups.join(large, F.col("deal") == F.col("l_deal"), "left")
    groups = groups.select(F.col("deal").alias("g_deal"), F.col("recipe").alias("g_recipe"), (-F.col("best.first")).alias("keep_id"), (-F.col("best.second")).alias("keep_row"), "group_size", F.explode(parted).alias("g_part"))
    part = F.when(F.col("l_deal").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
    dealt = keyed.join(large, F.col("deal") == F.col("l_deal"), "left").withColumn("part", part)
    joined = dealt.join(groups, (F.col("deal") == F.col("g_deal")) & (F.col("part") == F.col("g_part")) & (F.col("recipe") == F.col("g_recipe")), "left")
    alone = F.col("group_size").isNull()
    keep = lambda group, own: F.when(alone, F.col(own)).otherwise(F.col(group)).alias(group)
    return joined.select("row", "doc_id", keep("keep_row", "row"), keep("keep_id", "doc_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "text_sha256")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ident: Callable[[Column], Column] = sha_id) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null counts as
    empty, and empty texts form one group. Of a group the row with the most code
    points stays, then the smallest id. Rows that repeat an id each give a row,
    and those that repeat an id and its text are all marked as kept.
    Null ids come after all others in that choice, so a group of null ids alone
    has a null keep_id, and its rows are kept. An empty table gives no rows;
    other columns are not read.
    """
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return recipe_groups(rows, ident).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df`` of each group of equal texts, with all its columns.

    The row that exact_groups keeps; of several with that id and text, and of null
    ids alone, exactly one. An empty table gives no rows.
    """
    own = free_name(df, "own_row")
    held = stage(df.withColumn(own, F.monotonically_increasing_id()), "held")
    rows = held.select(F.col(own).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    gone = recipe_groups(rows).filter("row <> keep_row").select(F.col("row").alias(own))
    return held.join(few(gone, "gone"), own, "left_anti").select(*df.columns)
