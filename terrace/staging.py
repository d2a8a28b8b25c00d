"""Tables written to the folder that all executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it back. A lost executor then costs only the task it was running.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows, at most, that Spark sends to a Python worker at once; a longer row is sent alone.
BATCH_BYTES = 8_000_000
#: Bytes, at most, of a part of a batch that is worked on at once.
PART_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; on one machine, and only there, a temporary one where none is configured."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="terrace-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stage(df: DataFrame, tag: str, codec: str = "zstd", block: int | None = None, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table; ``block``: bytes, ``rows``: long rows a writer, and then a reader, holds at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    if block:
        writer = writer.option("parquet.block.size", block)
    if rows:
        writer = writer.option("parquet.block.row.count.limit", rows)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    object.__setattr__(out, "stage_path", path)
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = df.__dict__.get("stage_path")
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of one short key each, at most, that a join may send to every executor.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` of short rows, marked for broadcast if it is counted to have at most ``most``. Otherwise a join shuffles as usual."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def modest_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers get by bytes, where the session has Spark's larger bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = spark.conf.get(name).rstrip("b")
    if bound.isdigit() and int(bound) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, rows: int = 512, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch of at most ``rows`` rows and ``most`` bytes, so that what a part is turned into stays small; a longer row is a part of its own."""
    todo = [batch.slice(start, rows) for start in range(0, batch.num_rows, rows)][::-1]
    while todo:
        part = todo.pop()
        if part.num_rows < 2 or part.nbytes <= most:
            yield part
        else:
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]
