"""Snapshots that share work against ones built anew."""

from __future__ import annotations

import random

import pytest

from terrace.functions import go_refs, parsers
from terrace.operators import incremental

USES, DEFS = "file string, src string, name string, kind string", "file string, name string, target string"


def tree(r, files):
    out = {f: (n, [r.choice("abcdefgh") for _ in range(r.randint(0, 2))], [r.choice("abcdefgh") for _ in range(r.randint(0, 4))]) for n, f in enumerate(files)}
    uses = [(f, f"{f}.m", name, "calls") for f, (_, _, used) in out.items() for name in used]
    defs = [(f, name, f"{f}.{name}") for f, (_, own, _) in out.items() for name in own]
    return uses, defs


@pytest.mark.parametrize("seed", range(4))
def test_counts_after_changes(spark, seed):
    """Files that change, come and go; names that become ambiguous, single, or move."""
    r = random.Random(seed)
    names = [f"f{n}" for n in range(10)]
    uses, defs = tree(r, names[:8])
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges = incremental.edge_counts(table(uses, USES), table(defs, DEFS))
    for _ in range(3):
        changed = set(r.sample(names, 3))
        more_uses, more_defs = tree(r, [f for f in changed if r.random() < 0.8])
        new_uses, new_defs = [u for u in uses if u[0] not in changed] + more_uses, [d for d in defs if d[0] not in changed] + more_defs
        edges = incremental.changed_counts(edges, (table(uses, USES), table(new_uses, USES)), (table(defs, DEFS), table(new_defs, DEFS)), table([(f,) for f in changed], "file string"))
        uses, defs = new_uses, new_defs
        anew = incremental.edge_counts(table(uses, USES), table(defs, DEFS))
        assert sorted(map(tuple, edges.collect())) == sorted(map(tuple, anew.collect()))


def test_each_content_is_parsed_once(spark):
    one = {"a.go": "package a\n\nfunc F() { G() }\n", "b.go": "package a\n\nfunc G() {}\n", "c.py": "def f():\n    pass\n", "d.txt": "x"}
    two = one | {"b.go": "package a\n\nfunc G() {}\n\nfunc H() {}\n", "e.py": "def f():\n    pass\n"}
    store = incremental.ParseStore(spark)
    parsed = []
    for files in (one, two, two, one):
        df = spark.createDataFrame(list(files.items()), "path string, source string")
        units, refs, n = store.parsed(df)
        parsed.append(n)
        plain = lambda rows: sorted(map(str, rows))
        assert plain(units.collect()) == plain(parsers.parse_units(df).collect())
        assert plain(refs.collect()) == plain(go_refs.reference_table(df).collect())
    assert parsed == [4, 2, 0, 0] and store.digests().count() == 6
    assert store.parsed(df.limit(0))[2] == 0
