"""The queries of the training-data operators, over their whole tables, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe, exact, langid, linedup, lz, negatives, packing, pii, setsketch, urls, warc
from .common import table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on every machine; TERRACE_TOKENIZERS overrides the installed package."""
    folder = os.environ.get("TERRACE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def secret_key() -> bytes:
    """The key of the surrogates; TERRACE_PII_KEY sets it, and must be secret where surrogates are published."""
    return os.environ.get("TERRACE_PII_KEY", "terrace").encode()


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its personal data replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_pii(docs, secret_key()).select("doc_id", "n_entities", "text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines of runs of two lines or more, and the single lines of 50 words or more, that stand in an earlier place."""
    return linedup.drop_repeated_runs(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op3_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of their decoding."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, fitted on the documents whose remainder isn't 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.filter(~held_out), vocabulary("piece_bpe_32k.model"))
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, written to seekable bundles and read back."""
    return warc.archive(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents and the row of each that stays."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op7_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and its edited text, and their likeness."""
    return lz.fingerprints(table(spark, sf_dir, "documents"))


def op8_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies on shingles of two words."""
    return setsketch.near_groups(table(spark, sf_dir, "documents"), size=2, percent=80)


#: The rules that the query applies.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the url of each page."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two vocabularies in each document, and how common the links are."""
    return align.scored(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth row, with the label of every seventh row moved on."""
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(rows, rows.filter(F.col("vec_id") % 100 == 0))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every twentieth row."""
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), 20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii_surrogates, op2_line_dedup, op3_bpe_chunks, op4_language_id, op5_warc_bundles, op6_exact_dedup, op7_lz_fingerprint, op8_setsketch, op9_url_filter, op10_packing, op11_token_alignment, op12_hard_negatives, op13_nearest)
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
        g AS (
            SELECT body, count(*) AS group_size, arg_max(doc_id, (size, -doc_id)) AS keep_id FROM d GROUP BY body)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
        FROM d JOIN g USING (body)""",
    "op2_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
        w AS (
            SELECT doc_id, n, line, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS next FROM l),
        f AS (
            SELECT doc_id, n, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, n) AS copy FROM w WHERE next IS NOT NULL),
        s AS (
            SELECT doc_id, n, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) AS copy FROM l WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
        gone AS (
            SELECT doc_id, n + o AS n FROM f, (VALUES (0), (1)) AS v(o) WHERE copy > 1
            UNION SELECT doc_id, n FROM s WHERE copy > 1)
        SELECT l.doc_id, count(*) AS n_lines, count(gone.n) AS n_deleted, coalesce(string_agg(l.line, chr(10) ORDER BY l.n) FILTER (WHERE gone.n IS NULL), '') AS text
        FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.n = gone.n
        GROUP BY l.doc_id""",
    "op5_warc_bundles": r"""
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (
            SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
        FROM p LEFT JOIN f ON p.payload_bytes >= 100 AND p.payload_digest = f.payload_digest""",
    "op12_hard_negatives": r"""
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_dot_product(a.vec, c.vec) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
        p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
        FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
        WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
        QUALIFY row_number() OVER w <= 5""",
}
