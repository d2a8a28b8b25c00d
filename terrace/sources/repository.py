"""A source tree as a table: ``spark.read.format("terrace_repo").load(root)``.

The driver walks the tree once, pruning before it descends, and deals the files
out in partitions; the tasks read them. Symbolic links and files that aren't
regular are never followed or read, on any part of a path. Rows: path, source,
n_bytes.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import EngineError, Kind
from ..functions import ignore
from ..operators.scan import MAX_DEPTH, MAX_ENTRIES, MAX_FILE_BYTES, MAX_FILES, MAX_TOTAL_BYTES, excluded_name

IGNORE_FILE, MAX_IGNORE_BYTES, FILES_A_PARTITION = ".gitignore", 65_536, 64


def read_within(root: str, path: str, most: int = MAX_FILE_BYTES) -> bytes:
    """A regular file below ``root``; an error for a path that leaves it or passes a link."""
    parts = path.split("/")
    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in parts):
        raise EngineError(Kind.INVALID, f"not a path within the tree: {path!r}")
    here = root
    for n, part in enumerate(parts):
        here = os.path.join(here, part)
        try:
            mode = os.lstat(here).st_mode
        except OSError as e:
            raise EngineError(Kind.NOT_FOUND, path) from e
        if not (stat.S_ISREG(mode) if n == len(parts) - 1 else stat.S_ISDIR(mode)):
            raise EngineError(Kind.INVALID, f"not a regular file: {path!r}")
    with open(os.open(here, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0)), "rb") as f:
        data = f.read(most + 1)
    if len(data) > most:
        raise EngineError(Kind.TOO_LARGE, path)
    return data


def load_rules(root: str, directory: str) -> list[ignore.Rule]:
    """Rules of a directory; none without a file, and one that ignores everything if it can't be read."""
    path = f"{directory}/{IGNORE_FILE}" if directory else IGNORE_FILE
    try:
        return ignore.parse(read_within(root, path, MAX_IGNORE_BYTES).decode())
    except EngineError as e:
        return [] if e.kind is Kind.NOT_FOUND else [ignore.Rule(".*", False, False)]
    except (OSError, UnicodeDecodeError):
        return [ignore.Rule(".*", False, False)]


def rule_table(directories: DataFrame, root: str) -> DataFrame:
    """dir, depth, ord, regex, negate, dir_only: the rules of each directory (dir) of a tree, read where its row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, d.count("/") + bool(d), n, r.regex, r.negate, r.dir_only) for d in batch.column(0).to_pylist() for n, r in enumerate(load_rules(root, d))]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["dir", "depth", "ord", "regex", "negate", "dir_only"])

    return directories.select("dir").mapInArrow(run, "dir string, depth int, ord int, regex string, negate boolean, dir_only boolean")


def walk(root: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files to index, in order of path."""
    out: list[tuple[str, int]] = []
    layers: dict[str, list[ignore.Rule]] = {}
    entries, waiting = 0, [""]
    while waiting:
        directory = waiting.pop()
        layers[directory] = load_rules(root, directory)
        with os.scandir(os.path.join(root, directory)) as found:
            for e in found:
                entries += 1
                path = f"{directory}/{e.name}" if directory else e.name
                if entries > MAX_ENTRIES or path.count("/") > MAX_DEPTH:
                    raise EngineError(Kind.TOO_LARGE, f"the tree has more than {MAX_ENTRIES} entries or {MAX_DEPTH} levels")
                is_dir = e.is_dir(follow_symlinks=False)
                if excluded_name(e.name, is_dir) or ignore.ignored(path, is_dir, layers):
                    continue
                if is_dir:
                    waiting.append(path)
                elif e.is_file(follow_symlinks=False) and (size := e.stat(follow_symlinks=False).st_size) <= MAX_FILE_BYTES:
                    out.append((path, size))
    if len(out) > MAX_FILES or sum(n for _, n in out) > MAX_TOTAL_BYTES:
        raise EngineError(Kind.TOO_LARGE, f"the tree has more than {MAX_FILES} files or {MAX_TOTAL_BYTES} bytes")
    return sorted(out)


@dataclass
class Files(InputPartition):
    paths: list[str]


class RepositoryReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[Files]:
        paths = [p for p, _ in walk(self.root)]
        return [Files(paths[n : n + FILES_A_PARTITION]) for n in range(0, len(paths), FILES_A_PARTITION)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            data = read_within(self.root, path)
            yield path, data.decode(errors="replace"), len(data)


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terrace_repo"

    def schema(self) -> str:
        return "path string, source string, n_bytes int"

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(self.options["path"])
