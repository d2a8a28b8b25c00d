"""References and declarations of Go files as rows, for the joins that resolve them."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..staging import slices
from . import go_reader
from .parsers import GO_BLANK, balanced, blank

REFS = "kind string, path string, dir string, package string, line int, owner string, target_package string, target string, last int, scope string, base string, steps array<string>"


def references(path: str, source: str) -> list[tuple]:
    """Rows of REFS of one file; one that can't be read gives a row of kind ``diagnostic`` and no other."""
    folder = posixpath.dirname(path) or "."
    try:
        if not balanced(blank(source, GO_BLANK)):
            raise ValueError("brackets don't close in order")
        package, scope, found = go_reader.read(source, folder)
        if not package:
            raise ValueError("no package is named")
        if bad := next((r for r in found if r.kind == "diagnostic"), None):
            raise ValueError(f"line {bad.line}: {bad.target}")
    except (ValueError, RecursionError) as e:
        why = "it is nested too deeply" if isinstance(e, RecursionError) else str(e)
        return [("diagnostic", path, folder, "", 1, "", "", f"no relationships are known: {why}", 1, folder, "", [])]
    return [(r.kind, path, folder, package, r.line, r.owner, r.target_package, r.target, r.last, scope, r.base, list(r.steps)) for r in found]


def reference_table(files: DataFrame) -> DataFrame:
    """REFS of the Go files among ``files`` (path, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [c.rsplit(" ", 1) for c in REFS.split(", ")]
        types = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
        for part in (part for batch in batches for part in slices(batch)):  # a file may have many rows
            rows = [r for p, s in zip(*(c.to_pylist() for c in part.columns)) for r in references(p, s or "")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), types[t]) for c, (_, t) in zip(list(zip(*rows)) or [()] * len(fields), fields)], names=[n for n, _ in fields])

    return files.filter("path LIKE '%.go'").select("path", "source").mapInArrow(run, REFS)
