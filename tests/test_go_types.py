"""Calls of methods on values, resolved by types."""

from __future__ import annotations

import pytest

from terrace.functions import go_refs, parsers
from terrace.operators import source_graph

FILES = {
    "base/base.go": 'package base\n\ntype Log struct{}\n\nfunc (l *Log) Write() *Log { return l }\n\nfunc (l Log) Close() {}\n\ntype Face interface {\n\tShow() Log\n}\n\ntype List[T any] struct{ head *T }\n\nfunc (l *List[T]) Push(x T) *List[T] {\n\tx.Do()\n\treturn l\n}\n\nfunc Make() (*Log, error) { return &Log{}, nil }\n\nvar Shared, _ = Make()\n',
    "work/work.go": """package work

import (
	"net/http"

	b "example.com/m/base"
)

type Inner struct{ log *b.Log }

func (i Inner) Step() Inner { return i }

func (i *Inner) Twice() {}

type Left struct{}

func (Left) Twice() {}

type Outer struct {
	Inner
	*b.Log
	many map[string][]*Inner
	face b.Face
	hook func() Inner
}

type Both struct {
	Inner
	Left
}

type Named Outer
type Same = Outer
type Many []Inner

func (m Many) First() Inner { return m[0] }

func New() Outer { return Outer{} }

func (o *Outer) Close() {}
func (o *Outer) Serve(w http.ResponseWriter, r *http.Request) {}

var shared = New()
var later = shared.Inner

func chains(o *Outer, many Many) {
	o.Step().Step()
	o.log.Write().Write()
	o.Close()
	o.many["a"][0].Twice()
	o.hook().Twice()
	many.First().Step()
	many[1].Twice()
}

func shared_values() {
	shared.Write()
	later.Twice()
	b.Shared.Write()
	x, err := b.Make()
	_ = err
	x.Close()
}

func ambiguous(x Both) {
	x.Twice()
	x.Left.Twice()
	x.Step()
}

func faces(f b.Face, o Outer) {
	f.Show()
	f.Show().Close()
	o.face.Show().Write()
}

func shadows(o Outer) {
	{
		o := 3
		o.Step()
	}
	o.Step()
	if o, ok := any(o).(Left); ok {
		o.Twice()
	} else {
		o.Twice()
	}
	for _, o := range o.many["x"] {
		o.Step()
	}
	New := func() *Left { return nil }
	New().Twice()
	func(o Left) { o.Twice() }(Left{})
	type Left struct{}
	var l Left
	l.Twice()
}

func switched(v any) {
	switch x := v.(type) {
	case *Inner:
		x.Step()
	case Left, Outer:
		x.Twice()
	default:
		x.Twice()
	}
}

func made() {
	var l b.List[int]
	l.Push(1).Push(2)
	(*Outer).Close(nil)
	Named{}.Step()
	var s Same
	s.Close()
	New().Close()
	Many(nil).First()
	[]Outer{{}}[0].Step()
	new(Inner).Step()
	make(chan Outer, 1)
	c := make(chan *Outer)
	(<-c).Twice()
	go func() { defer New().Log.Write() }()
	http.HandleFunc("/", shared.Serve)
	http.Handle("/", http.HandlerFunc(nil))
}
""",
    "work/x_test.go": 'package work_test\n\nimport (\n\t"testing"\n\n\t"example.com/m/work"\n)\n\nfunc TestClose(t *testing.T) {\n\to := work.New()\n\to.Close()\n\tt.Run("a", nil)\n\tInner.Step()\n}\n',
    "work/bad.go": "package work\n\nfunc (m map) bad() { New().Close() }\n",
}


@pytest.fixture(scope="module")
def built(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, source string")
    units, refs = parsers.parse_units(files).cache(), go_refs.reference_table(files).cache()
    nodes, edges = source_graph.build(files, units, refs, "example.com/m")
    return nodes, [e.asDict() for e in edges.collect()], [tuple(d) for d in source_graph.diagnostics(refs).collect()]


def calls(edges, owner, kind="calls"):
    return sorted({e["dst"].split(":")[-1] for e in edges if e["kind"] == kind and e["src"].endswith(f":{owner}") and "method" in e["dst"]})


@pytest.mark.parametrize(
    "owner,want",
    [
        ("func chains", ["Inner.Step", "Inner.Twice", "Log.Write", "Many.First", "Outer.Close"]),
        ("func shared_values", ["Inner.Twice", "Log.Close", "Log.Write"]),
        ("func ambiguous", ["Inner.Step", "Left.Twice"]),
        ("func faces", ["Log.Close", "Log.Write"]),
        ("func shadows", ["Inner.Step", "Left.Twice"]),  # the name that an if defines holds in its else as well
        ("func switched", ["Inner.Step"]),
        ("func made", ["Inner.Step", "Inner.Twice", "List.Push", "Log.Write", "Many.First", "Outer.Close"]),
        ("func TestClose", ["Outer.Close"]),
        ("method List.Push", []),
    ],
)
def test_methods(built, owner, want):
    assert calls(built[1], owner) == [f"method {w}" for w in want]


def test_lines_of_ambiguous_and_shadowed_calls(built):
    """Of the calls in one function, just those that can be told give an edge."""
    at = {(e["src"].split(":")[-1], e["dst"].split(":")[-1]): (e["first"], e["last"]) for e in built[1] if e["kind"] == "calls"}
    lines = FILES["work/work.go"].split("\n")
    line = lambda text: lines.index(text) + 1
    assert at["func ambiguous", "method Left.Twice"] == (line("\tx.Left.Twice()"),) * 2
    assert at["func shadows", "method Inner.Step"] == (line("func shadows(o Outer) {") + 5,) * 2
    assert at["func shadows", "method Left.Twice"] == (line("	if o, ok := any(o).(Left); ok {") + 1,) * 2


def test_handlers_tests_and_origins(built):
    nodes, edges, _ = built
    assert calls(edges, "func made", "route-to-handler") == ["method Outer.Serve"]
    tested = [e for e in edges if e["kind"] == "tested-by" and e["src"].endswith("method Outer.Close")]
    assert [(e["dst"].split(":")[-1], e["provider"], e["origin"], e["first"]) for e in tested] == [("func TestClose", "go types", "work/x_test.go", 11)]
    assert {e["origin"] for e in edges if e["kind"] == "contains" and e["src"] == "file:base/base.go"} == {"base/base.go"}
    assert all(e["provider"] and e["detail"] and 1 <= e["first"] <= e["last"] for e in edges)
    assert nodes.filter("provider IS NULL OR origin IS NULL OR detail IS NULL OR first > last").isEmpty()


def test_files_that_cannot_be_read(built, spark):
    assert built[2] == [("work/bad.go", "no relationships are known: line 3: a receiver that is no type")]
    assert not [e for e in built[1] if "bad.go:" in e["src"]]
    for source, why in (("package a\nfunc f() {", "close"), ("func f() {}", "package")):
        (row,) = go_refs.references("a.go", source)
        assert row[0] == "diagnostic" and why in row[7]
    deep = "package a\nfunc f() { x(" + "(" * 20000 + ")" * 20000 + ") }"
    assert go_refs.references("a.go", deep)[0][7].endswith("nested too deeply")
