"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a table that is written and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import exact, langid, packing, pii, setsketch
from terrace.llm.common import modest_batches, stage
from terrace.llm.queries import secret_key, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; null texts, those without letters and those between languages go.

    Null and repeated ids make no difference, as in all stages; an empty table gives an empty one.
    """
    return langid.keep_identified(docs, langid.fit(docs, vocabulary("piece_bpe_32k.model")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space; null texts count as empty ones.

    Exactly one row of a group stays, also where ids are null or repeat.
    """
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: shingles of five words, similarity 0.8.

    Exactly one row of a group stays, also where ids are null or repeat; texts without words all stay.
    """
    return setsketch.drop_near_copies(docs, size=5, percent=80)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced; n_chars follows a text that changed. All rows stay, null texts as null."""
    out = pii.replace_pii(docs, secret_key())
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 ids; null texts count as empty, and each row is packed."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii_surrogates", pii_surrogates), ("packing", pack)]

#: Language ID and packing are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    modest_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, function) in enumerate(STAGES, 1):
        docs = function(spark, docs, sf_dir)
        if n < len(STAGES):
            docs = stage(docs, name)
    return docs
