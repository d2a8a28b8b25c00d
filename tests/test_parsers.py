"""Units of each language, on small files of our own."""

import pyarrow as pa
import pytest

from terrace.functions import go_refs, parsers
from terrace.functions.parsers import Parser, Registry, Unit, default_registry, no_units, parse_file, vault_encrypted

REGISTRY = default_registry()


def spans(path, source):
    return [(r[4], r[5], r[6]) for r in parse_file(REGISTRY, path, source)]


def test_python():
    source = 'import x\n\n@first\n@second\ndef one():\n    """text\nat the margin\n    """\n    return 1\n\n\nclass Two:\n    def inner(self):\n        pass\n\nLAST = 1\n'
    assert spans("a.py", source) == [("func one", 3, 11), ("class Two", 12, 15)]
    wrapped = "def f(\n    a,\n):\n    # c\n# margin\n    return a\n\ndef g(): pass\n"
    assert spans("a.py", wrapped) == [("func f", 1, 7), ("func g", 8, 9)]
    assert spans("a.py", "x = 1\n") == [("a.py", 1, 2)]
    assert spans("a.py", "async  def f():\n\tpass\ndef f():\n\tpass\n")[0][0] == "func f"
    assert [r[2] for r in parse_file(REGISTRY, "a.py", "def f(): 1\ndef f(): 2\ndef f(): 3")] == ["a.py:func f", "a.py:func f#2", "a.py:func f#3"]


def test_shell():
    source = "f() {\n  if true; then { echo \"}\"; }; fi # }\n  echo ${#x[@]} '}'\n}\nfunction g {\n  cat <<-'END'\n}\n\tEND\n}\nbare {\n}\none() { echo; }\n"
    assert spans("a.sh", source) == [("function f", 1, 4), ("function g", 5, 9), ("function one", 12, 12)]
    assert spans("run", "#!/usr/bin/env bash\nf() {\n}\n") == [("function f", 2, 3)]
    assert spans("run", "#!/usr/bin/fish\nf() {\n}\n") == []


def test_go():
    source = "package a\n\nimport \"os\"\n\n// func no() {}\nfunc One(f func(int) int) (map[string]int, error) {\n\ts := \"}\"\n\treturn nil, nil\n}\n\ntype T struct {\n\tx int\n}\n\nfunc (t *T) Run() {\n}\n\nfunc (u U[K]) Run() {\n}\n\ntype (\n\tA int\n\tB interface {\n\t\tM()\n\t}\n)\n"
    assert spans("a.go", source) == [("func One", 6, 9), ("type T", 11, 13), ("method T.Run", 15, 16), ("method U.Run", 18, 19), ("type A", 22, 22), ("type B", 23, 25)]
    assert spans("a.go", "package a\nfunc broken( {\n") == [("a.go", 1, 3)]


def test_terraform():
    source = 'module "net" {\n  source = "../shared/net"\n}\nmodule "far" {\n  source = "registry/net"\n}\nresource "kind" "name" {\n  a = "{"\n  b {\n  }\n}\nlocals {\n}\n'
    rows = parse_file(REGISTRY, "env/prod/main.tf", source)
    assert [(r[4], r[5], r[6]) for r in rows] == [("module net", 1, 3), ("module far", 4, 6), ("resource kind.name", 7, 11), ("locals", 12, 13)]
    assert [r[7] for r in rows] == [["env/shared/net"], [], [], []]


def test_yaml():
    plays = "# top\n- name:  First   play\n  hosts: all\n  tasks:\n    - ping:\n\n# about the next\n- hosts: web\n---\n- import_playbook: more.yml\n"
    assert spans("site.yml", plays) == [("play First play", 2, 5), ("play web", 8, 8), ("play more.yml", 10, 10)]
    tasks = "- name: [1]\n  copy:\n    a: b\n- block:\n    - ping:\n- my.own.thing:\n  when: x\n- copy: {}\n"
    assert spans("tasks/main.yaml", tasks) == [("task copy", 1, 3), ("task block", 4, 5), ("task my.own.thing", 6, 7), ("task copy", 8, 8)]
    for plain in ("- name: a\n  x: 1\n  y: 2\n", "a: 1\n", "- 1\n", ": : [\n", "- a\n---\napiVersion: v1\nkind: Pod\n"):
        assert [r[1] for r in parse_file(REGISTRY, "x.yml", plain)] == ["yaml"]
    assert vault_encrypted("a.txt", "$ANSIBLE_VAULT;1.1;AES256\n00") and vault_encrypted("a.yml", "k: !vault |\n  $ANSIBLE_VAULT;1\n") and not vault_encrypted("a.md", "see\n  $ANSIBLE_VAULT;1\n")
    long = "".join(f"- hosts: h{n}\n  vars: {{a: {'x' * 200}}}\n" for n in range(60))
    assert len(spans("long.yml", long)) == 60


def test_registry():
    peeks = []

    def claim(path, peek):
        peeks.append(peek)
        return True

    low, high = Parser("low", 1, claim, no_units), Parser("high", 2, claim, lambda p, s: [Unit("k", "n", 1, 2)])
    assert Registry(low, high).parse("p", "é" * 5000) == ("high", [Unit("k", "n", 1, 2)])
    assert len(peeks[0].encode()) <= 4096
    with pytest.raises(ValueError):
        Registry(low, Parser("other", 1, claim, no_units))
    assert default_registry().parse("a.bin", "x") is None


def test_table_function(spark):
    from terrace.functions import parsers

    files = spark.createDataFrame([("a.py", "def f(): 1"), ("b.md", "x"), ("c.bin", "x"), ("d.py", None)], "path string, source string")
    got = {(r.path, r.name, r.start, r.end) for r in parsers.parse_units(files).collect()}
    assert got == {("a.py", "func f", 1, 1), ("b.md", "b.md", 1, 1), ("d.py", "d.py", 1, 1)}
    files.createOrReplaceTempView("some_files")
    parsers.register_udtf(spark)
    assert spark.sql("SELECT u.name FROM some_files f, LATERAL parse_units(f.path, coalesce(f.source, '')) u").count() == 3


class OneBatch:
    """Stands for a table whose rows come to the reader in one batch."""

    def __init__(self, batch):
        self.batch = batch

    def filter(self, *_):
        return self

    select = filter

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


@pytest.mark.parametrize("reader", [parsers.parse_units, go_refs.reference_table])
def test_a_batch_is_read_in_parts(reader):
    """Rows of many files, of which each has many, are never held at once, and all come, in order."""
    sources = [f"package p\n\nfunc F{n}() {{}}\n\nfunc G{n}() {{ F{n}() }}\n" for n in range(1300)]
    of = lambda lo, hi: OneBatch(pa.RecordBatch.from_arrays([pa.array([f"p/{n}.go" for n in range(lo, hi)]), pa.array(sources[lo:hi])], names=["path", "source"]))
    parts = reader(of(0, 1300))
    assert len(parts) == 3
    assert [r for p in parts for r in p.to_pylist()] == [r for n in range(0, 1300, 100) for p in reader(of(n, n + 100)) for r in p.to_pylist()]
