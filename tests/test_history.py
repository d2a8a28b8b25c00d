"""Histories of lines against a replay of each version, line by line."""

from __future__ import annotations

import random

import pytest

from terrace.functions.diff import diff_ops, source_lines
from terrace.operators import history


def chains(seed, files=4):
    r = random.Random(seed)
    out = {}
    for f in range(files):
        lines, versions = [f"l{r.randint(0, 20)}" for _ in range(r.randint(0, 12))], []
        for _ in range(r.randint(1, 14)):
            for _ in range(r.randint(0, 3)):
                at = r.randint(0, len(lines))
                lines = lines[:at] + [f"l{r.randint(0, 20)}" for _ in range(r.randint(0, 3))] + lines[at + r.randint(0, 2) :]
            versions.append("".join(x + "\n" for x in lines))
        out[f"f{f}"] = versions
    return out


def replayed(versions):
    """The version that each line of the last one comes from."""
    lines: list[int] = []
    for n, (before, after) in enumerate(zip(["", *versions], versions), 1):
        now, i = [], 0
        for op in diff_ops(source_lines(before), source_lines(after)):
            if op == "+":
                now.append(n)
            else:
                now += [lines[i]] if op == " " else []
                i += 1
        lines = now
    return lines


def walked(versions, start, end, most):
    """Versions that changed a range, by marks on lines: those of the range, or that replaced or were between them."""
    found = []
    for n in range(len(versions), 0, -1):
        a, b = source_lines(versions[n - 2] if n > 1 else ""), source_lines(versions[n - 1])
        i = j = 0
        runs, same = [], {}
        for op in diff_ops(a, b):
            if op == " ":
                same[j] = i
                runs.append(None)
            else:
                if not runs or runs[-1] is None:
                    runs.append([i, i, j, j])
                runs[-1][1] += op == "-"
                runs[-1][3] += op == "+"
            i, j = i + (op != "+"), j + (op != "-")
        hit = [x for x in runs if x and (x[2] < end and x[3] > start - 1 if x[3] > x[2] else start - 1 < x[2] < end)]
        if hit:
            found.append(n)
        old = [same[k] for k in range(start - 1, end) if k in same] + [k for x in hit for k in range(x[0], x[1])]
        if len(found) == most or not old:
            break
        start, end = min(old) + 1, max(old) + 1
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_replay(spark, seed):
    files, r = chains(seed), random.Random(seed)
    versions = spark.createDataFrame([(f, n, f"c{n}", s) for f, vs in files.items() for n, s in enumerate(vs, 1)] + [(None, 1, "c1", "x\n")], "file string, n long, commit string, source string").repartition(3)
    changes = history.version_edits(versions).cache()
    newest = spark.createDataFrame([(f, vs[-1]) for f, vs in files.items() if vs[-1]], "file string, source string")
    got = {}
    for x in history.line_origins(changes, newest).collect():
        got.setdefault(x.file, {})[x.line] = x.commit
    assert got == {f: {k: f"c{n}" for k, n in enumerate(replayed(vs), 1)} for f, vs in files.items() if vs[-1]}
    units = []
    for f, vs in files.items():
        size = len(source_lines(vs[-1]))
        units += [(f, f"u{k}", a := r.randint(1, size), r.randint(a, size)) for k in range(6) if size]
    units += [("f0", "none", 3, 2), ("gone", "u", 1, 2), (None, "u", 1, 1)]
    found = {}
    for x in history.unit_history(changes, spark.createDataFrame(units, "file string, unit string, start int, end int")).orderBy("file", "unit", "rank").collect():
        found.setdefault((x.file, x.unit), []).append((x.rank, x.commit))
    want = {(f, u): [(k, f"c{n}") for k, n in enumerate(walked(files[f], a, b, 5), 1)] for f, u, a, b in units if f in files and a <= b}
    assert found == {k: v for k, v in want.items() if v}


def test_empty(spark):
    versions = spark.createDataFrame([], "file string, n long, commit string, source string")
    assert history.unit_history(history.version_edits(versions), spark.createDataFrame([("f", "u", 1, 2)], "file string, unit string, start int, end int")).collect() == []
