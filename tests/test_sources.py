"""Source trees and version control, on small repositories made here."""

import os
import subprocess

import pytest

from terrace.errors import EngineError, Kind
from terrace.functions import go_refs, ignore, parsers
from terrace.operators import source_graph
from terrace.sources import git, repository


def write(root, files):
    for path, text in files.items():
        full = os.path.join(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w") as f:
            f.write(text)


def test_ignore_rules():
    layers = {"": ignore.parse("*.log\n/out/\nlogs/\n!keep.log\na/**/x\n#c\n\\#odd\ntrail\\ \n"), "sub": ignore.parse("!deep.log\n")}
    hit = lambda p, d=False: ignore.ignored(p, d, layers)
    assert hit("a.log") and hit("in/b.log") and not hit("keep.log") and not hit("sub/deep.log")
    assert hit("out/f") and not hit("in/out/f") and hit("in/logs/f") and not hit("logs")
    assert hit("a/x") and hit("a/b/x") and hit("a/b/c/x") and not hit("a/b/xy")
    assert hit("#odd") and hit("trail ")
    assert ignore.ignored("dir/keep.txt", False, {"": ignore.parse("dir/\n!dir/keep.txt")})  # a pruned directory stays pruned
    for odd in ("[]", "[z-a]", "[!]", "[", "a[b"):
        for rule in ignore.parse(odd):
            assert ignore.ignored(odd, False, {"": [rule]})
    assert ignore.ignored("b.c", False, {"": ignore.parse("[!a].[a-d]")})


def test_walk(tmp_path, spark):
    root = str(tmp_path)
    write(root, {"a.py": "x", ".gitignore": "skip/\n", "skip/b.py": "x", "sub/.gitignore": "*.md\n", "sub/c.md": "x", "sub/d.txt": "é", "node_modules/e.js": "x", "terraform.tfvars": "s", ".env": "s", "x.tfstate.1": "s", "config.json": "{}", "big.txt": "y" * 300_000})
    os.symlink("/etc/passwd", os.path.join(root, "link.txt"))
    os.symlink(os.path.join(root, "sub"), os.path.join(root, "linked"))
    want = [".gitignore", "a.py", "sub/.gitignore", "sub/d.txt"]
    assert [p for p, _ in repository.walk(root)] == want
    git.register(spark)
    rows = spark.read.format("terrace_repo").load(root).orderBy("path").collect()
    assert [r.path for r in rows] == want and rows[-1].n_bytes == 2
    for bad, kind in (("../x", Kind.INVALID), ("link.txt", Kind.INVALID), ("linked/d.txt", Kind.INVALID), ("none", Kind.NOT_FOUND), ("big.txt", Kind.TOO_LARGE), ("/etc/passwd", Kind.INVALID)):
        with pytest.raises(EngineError) as e:
            repository.read_within(root, bad)
        assert e.value.kind is kind


def run(root, *args, when="2024-01-01T00:00:00Z"):
    env = os.environ | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@example.com", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@example.com"}
    subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, env=env)


def test_git(tmp_path, spark):
    root = str(tmp_path)
    write(root, {"a.txt": "one\n", "b/c.txt": "two\n"})
    run(root, "init", "-q")
    run(root, "add", ".")
    run(root, "commit", "-qm", "first")
    write(root, {"a.txt": "one\nmore\n"})
    run(root, "commit", "-qam", "second", when="2024-02-01T00:00:00Z")
    git.register(spark)
    load = lambda kind, **o: spark.read.format(kind).options(path=root, **o).load().collect()
    log = load("terrace_git_log")
    assert [(r.subject, sorted(r.paths)) for r in log] == [("second", ["a.txt"]), ("first", ["a.txt", "b/c.txt"])] and log[0].parents == [log[1].commit]
    tree = {r.path: r.blob_id for r in load("terrace_git_tree", revision="HEAD~1")}
    assert set(tree) == {"a.txt", "b/c.txt"} == {r.path for r in load("terrace_git_tree")}
    blobs = load("terrace_git_blob", ids=",".join(tree.values()))
    assert {bytes(r.content) for r in blobs} == {b"one\n", b"two\n"}
    from terrace.functions.text import blob_identity
    from pyspark.sql import functions as F

    assert spark.range(1).select(blob_identity(F.lit("one\n")).alias("i")).first().i == tree["a.txt"]
    assert [(r.line, r.ts, r.text) for r in load("terrace_git_blame", file="a.txt")] == [(1, 1704067200, "one"), (2, 1706745600, "more")]
    assert git.first_parent(root, git.resolve(root, "HEAD")) == log[1].commit and len(git.first_parent(root, log[1].commit)) == 40
    for bad in ("--all", "none", "a b"):
        with pytest.raises(EngineError):
            git.resolve(root, bad)
    with pytest.raises(EngineError):
        git.git(root, "log", "-p", most=10)


MODULE = {
    "main.go": 'package main\n\nimport "example.com/m/work"\n\nfunc main() {\n\twork.Do()\n}\n',
    "work/work.go": 'package work\n\nimport (\n\t"net/http"\n\t"os"\n)\n\nfunc Do() {\n\thelper()\n\tos.Getenv("X")\n\thttp.HandleFunc("/", serve)\n}\n\nfunc helper() {}\n\nfunc serve() {}\n\ntype A struct{}\n\nfunc (a A) Run() {}\n\ntype B struct{}\n\nfunc (b B) Run() { helper() }\n\nfunc shadow() {\n\thelper := func() {}\n\thelper()\n\tvar r interface{ Run() }\n\tr.Run()\n}\n',
    "work/work_test.go": 'package work\n\nimport "testing"\n\nfunc TestDo(t *testing.T) {\n\tDo()\n}\n',
    "infra/main.tf": 'module "net" {\n  source = "./net"\n}\n',
    "infra/net/net.tf": 'resource "r" "one" {\n}\n',
    "README.md": "text\n",
}


def test_source_graph(spark):
    files = spark.createDataFrame(list(MODULE.items()), "path string, source string")
    units, refs = parsers.parse_units(files).cache(), go_refs.reference_table(files).cache()
    nodes, edges = source_graph.build(files, units, refs, "example.com/m")
    got = {(e.src.split(":", 1)[1], e.dst.split(":", 1)[1], e.kind) for e in edges.collect()}
    calls = {(a, b) for a, b, k in got if k == "calls"}
    work = "work/work.go:"
    assert calls == {("main.go:func main", work + "func Do"), (work + "func Do", work + "func helper"), (work + "method B.Run", work + "func helper"), ("work/work_test.go:func TestDo", work + "func Do")}
    assert (work + "func Do", "work/work_test.go:func TestDo", "tested-by") in got
    assert (work + "func Do", work + "func serve", "route-to-handler") in got
    assert ("main.go", "work/work.go", "imports") in got and ("main.go", "work/work_test.go", "imports") not in got
    assert ("infra/main.tf:module net", "infra/net/net.tf:resource r.one", "local-module-source") in got
    by_id = {n.id: n for n in nodes.collect()}
    assert by_id["unit:main.go:func main"].roles == ["entry point"] and by_id["unit:main.go:func main"].score == 102
    assert by_id[f"unit:{work}func Do"].roles == ["configuration", "network boundary"] and by_id[f"unit:{work}func Do"].callers == 1
    assert by_id["unit:work/work_test.go:func TestDo"].roles == ["test", "test support"]
    assert {"package:work:work", "package:.:main"} <= set(by_id)
    from terrace.operators import navigation

    stops = [r.id for r in navigation.architecture(nodes, edges).orderBy("stop_no").collect()]
    assert stops[:4] == ["unit:main.go:func main", f"unit:{work}func Do", f"unit:{work}func serve", f"unit:{work}func helper"]
