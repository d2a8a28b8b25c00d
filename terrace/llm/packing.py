"""Packing by concatenate and cut.

Pass one encodes every document and keeps, within its partition, the number of
ids before it; the encoded table is written. Pass two sums the partitions'
totals, one small row each, into global offsets, so that every document knows
its place in the one long row of ids. That row is cut into windows of a fixed
length; a document that crosses a window's end gives a boundary record on either
side. Only the last window can be short, and it alone is padded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import CHUNK_BYTES, PIECE_BYTES, encoder
from .common import slices, stage

#: Bytes of ids that a writer holds before it writes them out.
ROW_GROUP = 16 << 20


def encode_partitions(df: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table: id, part, before (ids earlier in the partition), n, ids (little-endian 32-bit, with the end id)."""

    def run(batches):
        # No chunks are kept here, so pieces have their room as well: emptied more often, the store would encode frequent ones again.
        enc, end = encoder(tokenizer, PIECE_BYTES + CHUNK_BYTES), np.array([end_id], "<u4").tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch):
                ids = [enc.plain(t) + end for t in rows.column(1).to_pylist()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                first = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([part] * len(ids), pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=[rows.schema.names[0], "part", "before", "n", "ids"])

    id_type = df.schema[id_col].dataType.simpleString()
    encoded = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, part long, before long, n long, ids binary")
    return stage(encoded, "encoded", block=ROW_GROUP)


def cut(encoded: DataFrame, length: int, id_col: str = "doc_id") -> DataFrame:
    """One row for each piece of a document within a window of ``length`` ids.

    The totals have one row for each task of pass one, whatever the number of
    documents; the window that sums them therefore runs over that many rows.
    """
    totals = encoded.groupBy("part").agg(F.sum("n").alias("total"))
    offsets = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("shift"))
    placed = encoded.join(F.broadcast(offsets), "part").withColumn("place", F.col("shift") + F.col("before"))
    first, last = F.floor(F.col("place") / length), F.floor((F.col("place") + F.col("n") - 1) / length)

    def piece(w):
        start = F.greatest(w * length - F.col("place"), F.lit(0))
        stop = F.least((w + 1) * length - F.col("place"), F.col("n"))
        return F.struct(
            start.alias("start"), (stop - start).alias("length"),
            F.crc32(F.substring("ids", (4 * start + 1).cast("int"), (4 * (stop - start)).cast("int"))).alias("ids_crc32"),
            w.alias("sequence_id"), (F.col("place") + start - w * length).alias("offset"),
        )

    pieces = placed.select(id_col, F.col("n").alias("doc_tokens"), F.transform(F.sequence(first, last), piece).alias("pieces"))
    return pieces.select(id_col, "doc_tokens", F.explode("pieces").alias("p")).select(id_col, "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset")


def pack(df: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document, null texts as empty, into windows of ``length`` ids.

    Each document is its ids and ``end_id``, so an empty one still has a piece.
    An empty table gives no rows; null or repeated ids are packed row by row;
    other columns are not read. A document's ids may have up to 2^31 / 4 members.
    """
    return cut(encode_partitions(df, tokenizer, end_id, id_col, text_col), length, id_col)
