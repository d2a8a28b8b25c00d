"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames, and a skippable frame at
the end of each bundle holds the seek table: compressed and plain size of every
frame, then the number of frames and a magic number. An index maps each record's
identifier to its bundle, frame and offset within the frame's plain bytes, so one
record is read by decompressing one frame.

Bundles are rows of a written table (bundle, content): Spark's own writer puts
them on whatever store the shared folder is in, and only committed tasks' bundles
are ever seen. ``export`` writes them as files where a folder is mounted.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, slices, stage

#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEAST_REVISIT = 256_000, 4_000_000, 100
DATE = "2024-01-01T00:00:00Z"


class Bundle:
    """A bundle being written."""

    def __init__(self, level: int = 3):
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.out, self.plain, self.held, self.size = [], [], 0, 0

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number and offset within the frame's plain bytes."""
        if self.held >= FRAME_BYTES:
            self.end_frame()
        at = len(self.frames), self.held
        self.plain.append(record)
        self.held += len(record)
        return at

    def end_frame(self) -> None:
        if self.plain:
            data = self.zstd.compress(b"".join(self.plain))
            self.frames.append((len(data), self.held))
            self.out.append(data)
            self.size += len(data)
            self.plain, self.held = [], 0

    def finish(self) -> bytes:
        self.end_frame()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        return b"".join([*self.out, struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)), entries, footer])


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, read from the end of the bundle."""
    count, _, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    table = bundle[len(bundle) - 9 - 8 * count : -9]
    out, start = [], 0
    for n in range(count):
        packed, plain = struct.unpack_from("<II", table, 8 * n)
        out.append((start, packed, plain))
        start += packed
    return out


def frame(bundle: bytes, entry: tuple[int, int, int]) -> bytes:
    import zstandard

    start, packed, plain = entry
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=plain)


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}:{payload_digest[:16]}>"


def page_of(identifier: str | None) -> int | None:
    m = re.match(r"<urn:x-page:(-?\d+):", identifier or "")
    return int(m[1]) if m else None


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has headers and no payload."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x1f\x7f]', lambda m: f'%{ord(m[0]):02X}', url or '')}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: {record_id(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def read_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the place after the record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines if ": " in line)
    start, size = end + 4, int(head["Content-Length"])
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} doesn't end where its length says")
    return head, data[start : start + size], start + size + 4


def with_targets(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, digest, refers_to.

    Only digests and ids are grouped. Groups of one need no partner, so one side
    of the join has a row for each digest that repeats. While those are few the
    payloads stay where they are; beyond that both sides shuffle, and Spark splits
    a hot digest's partition.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    first = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("d"), "first")
    joined = rows.join(few(first, "copies"), F.col("digest") == F.col("d"), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("first") < F.col("page_id"), F.col("first")).when(F.col("page_id").isNull(), F.col("first")).alias("refers_to"))


def write_bundles(targets: DataFrame) -> DataFrame:
    """Written table: bundle, content (binary), index (array of record_id, frame, frame_offset, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        bundle, index = Bundle(), []

        def close():
            nonlocal bundle, index, n
            out = pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{n:06d}"]), pa.array([bundle.finish()], pa.binary()), pa.array([index], pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64()), ("length", pa.int64())])))], names=["bundle", "content", "index"])
            bundle, index, n = Bundle(), [], n + 1
            return out

        for batch in batches:
            for row in (row for part in slices(batch, 256) for row in part.to_pylist()):
                data = write_record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                at = bundle.add(data)
                index.append({"record_id": record_id(row["page_id"], row["digest"]), "frame": at[0], "frame_offset": at[1], "length": len(data)})
                if bundle.size >= BUNDLE_BYTES:
                    yield close()
        if index:
            yield close()

    schema = "bundle string, content binary, index array<struct<record_id: string, frame: int, frame_offset: bigint, length: bigint>>"
    return stage(targets.mapInArrow(run, schema), "bundles", "none")


def index_of(bundles: DataFrame) -> DataFrame:
    """record_id, bundle, frame, frame_offset, length."""
    return bundles.select("bundle", F.explode("index").alias("r")).select("r.record_id", "bundle", "r.frame", "r.frame_offset", "r.length")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read back through the index.

    Each frame is found by the seek table and decompressed once; each record is
    taken at its frame-relative offset. A response's digest and length are those
    of the bytes read; a revisit states those of the payload that it refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for row in (row for one in slices(batch, 1) for row in one.to_pylist()):
                content, frames, at, plain, out = row["content"], seek_table(row["content"]), -1, b"", []
                for x in row["index"]:
                    if x["frame"] != at:
                        at = x["frame"]
                        plain = frame(content, frames[at])
                    head, payload, end = read_record(plain, x["frame_offset"])
                    if end - x["frame_offset"] != x["length"] or head["WARC-Record-ID"] != x["record_id"]:
                        raise ValueError(f"the index is wrong about {x['record_id']}")
                    kind, said = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                    digest = hashlib.sha256(payload).hexdigest() if kind == "response" else said
                    if digest != said:
                        raise ValueError(f"the payload of {x['record_id']} isn't what was written")
                    out.append((page_of(head["WARC-Record-ID"]), len(payload) if kind == "response" else int(head["X-Payload-Length"]), digest, kind, page_of(head.get("WARC-Refers-To"))))
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in enumerate(types)], names=names)

    return bundles.select("content", "index").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Write each bundle as FOLDER/NAME.warc.zst, in a folder mounted on all executors; bundle, path, bytes."""

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            names, paths, sizes = [], [], []
            for row in (row for one in slices(batch, 1) for row in one.to_pylist()):
                path = os.path.join(folder, f"{row['bundle']}.warc.zst")
                part = f"{path}.{TaskContext.get().taskAttemptId()}"
                with open(part, "wb") as f:
                    f.write(row["content"])
                os.replace(part, path)  # a task that runs twice leaves one whole file
                names.append(row["bundle"])
                paths.append(path)
                sizes.append(len(row["content"]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["bundle", "path", "bytes"])

    return bundles.select("bundle", "content").mapInArrow(run, "bundle string, path string, bytes long")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for every page and read them all back.

    Null html is an empty payload. Of equal payloads of at least 100 bytes the
    one with the smallest page_id is a response; rows that repeat that id are
    responses too. A null id comes after all others: it revisits if any page with
    an id has the payload. Null urls are empty. An empty table gives no rows;
    other columns are not read.
    """
    return read_bundles(write_bundles(with_targets(pages, id_col, url_col, html_col)))
