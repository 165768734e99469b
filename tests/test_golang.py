"""The reader of Go sources: trees, types, failures, and metrics of known routines."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import syntax
from plumbline.sources import golang


def body(text, name="f"):
    f = golang.read(f"package p\nfunc (t *T) {name}() {{\n{text}\n}}\n")["functions"][0]
    return golang._tidy(f["body"])


@pytest.mark.parametrize(
    ("text", "cyclomatic", "cognitive", "npath"),
    [
        ("", 1, 0, 1),
        ("if a { }", 2, 1, 2),
        ("if a && b || c { } else { x() }", 4, 4, 5),
        ("if a { } else if b { } else { }", 3, 3, 3),
        ("for { if a { break } }", 4, 3, 2),
        ("for i := 0; i < 3; i++ { }", 2, 1, 2),
        ("for range xs { for _, x := range xs { continue } }", 4, 3, 3),
        ("switch x { case 1: a(); fallthrough\ncase 2: b()\ndefault: c() }", 3, 1, 3),
        ("switch y := x.(type) { case int: case *T, []string: return }", 3, 1, 3),
        ("select { case v := <-c: use(v)\ncase d <- 1:\ndefault: }", 3, 1, 3),
        ("a:\n for { for { continue a } }", 4, 4, 1),
        ("t.f(); g(func() { if a { t.f() } })", 1, 4, 1),
        ("panic(a && b)", 2, 1, 2),
        ("x := []T{{a: 1}, {b: f(!a)}}; y := map[string]T{\"k\": {}}; _ = x[1:2]; return", 1, 1, 1),
        ("for _, v := range []string{\"a\"} { if p.T(v) == (q.T{}) { } }", 3, 3, 3),
        ("var f func(int) (string, error) = nil; defer f(1); go func() {}()", 1, 1, 1),
        ("goto end\nend:\n", 2, 1, 1),
        ("x, ok := <-c; c <- x; x++; x &^= 1; x <<= 0x1F; y := 'a' + '\\'' + 1.5e3 + .5i", 1, 0, 1),
        ("s := `raw\n}`; if s == \"}\\\"\" { } // }\n/* { */", 2, 1, 2),
    ],
)
def test_known_routines(text, cyclomatic, cognitive, npath):
    b = body(text)
    assert (syntax.cyclomatic(b), syntax.npath(b)) == (cyclomatic, npath)
    assert syntax.cognitive("f", b) == cognitive


def test_declarations():
    got = golang.read(
        """package p
import ( "a"; x "b/c"; . "d" )
const ( A = iota; B )
type ( T struct { a, b int `json:"a"`; *Base; io.Reader; f func(int, ...string) (n int, err error) }
 I interface { Run(ctx context.Context, n ...int) (int, error); fmt.Stringer; ~int | ~string } )
type M[K comparable, V any] map[K][]chan<- V
func Map[K comparable, V any](m map[K]V, f func(K) V) []V
func (m *M[K, V]) Get(k K) (v V, ok bool) { v.field = other.field; return m.inner[k], q.Call() }
func init() { type local struct{ z int }; var v local; _ = v }
"""
    )
    assert got["imports"] == ["a", "b/c", "d"]
    assert [(t["type"], t["kind"], t["fields"], t["methods"]) for t in got["types"]] == [("T", "struct", ["a", "b", "Base", "Reader", "f"], 0), ("I", "interface", [], 1), ("M", "named", [], 0)]
    assert [(f["name"], f["receiver"], f["parameters"], f["results"], f["fields"], f["foreign_fields"]) for f in got["functions"]] == [("Map", "", 2, 1, [], []), ("Get", "M", 1, 2, ["inner"], ["other.field", "v.field"]), ("init", "", 0, 0, [], [])]
    assert got["functions"][0]["body"] is None and got["functions"][2]["line"] == 9


def test_failures_stay_alone(spark):
    good = "package p\ntype T struct { a, b int }\nfunc (t *T) X() { if t.a > 0 { } }\nfunc (t *T) Y() int { return t.a + t.b }\nfunc (t *T) Z(o *U) { o.c = 1; var s Other; _ = s }\nfunc free() {}\n"
    rows = [("p/a.go", good), ("p/b.go", "package p\nfunc {"), ("q/c.go", "package q\nvar s = \"open"), ("q/d.go", None), ("r/e.go", "package r\n\ntype I interface { A(); B() }"), ("top.go", "package t"), ("r/f.go", "")]
    files = spark.createDataFrame(rows, "path string, content string")
    found = golang.facts(files)
    assert {r.path for r in golang.failures(found).collect()} == {"p/b.go", "q/c.go", "q/d.go", "r/f.go"}
    measured = syntax.measure(golang.routines(found))
    assert {(r.path, r.fn): r.cyclomatic for r in measured.collect()} == {("p/a.go", "T.X"): 2, ("p/a.go", "T.Y"): 1, ("p/a.go", "T.Z"): 1, ("p/a.go", "free"): 1}
    got = {r.type: (r.wmc, r.atfd, round(r.tcc, 4), r.cbo) for r in golang.class_facts(found, measured).collect()}
    assert got == {"T": (4, 1, 33.3333, 2), "I": (2, 0, 0.0, 0)}
    state = {(r.path, r.component): r.state for r in golang.coverage(files, golang.failures(found), ["cog", "god"], ["god"]).collect()}
    assert state["p/a.go", "cog"] == "complete" and state["p/a.go", "god"] == "unavailable" and state["p/b.go", "cog"] == "failed" and state["top.go", "god"] == "complete" and len(state) == 14
    assert golang.facts(files.limit(0)).count() == 0
    text = found.where(F.col("name") == "X").first().body
    assert json.loads(text)[0]["kind"] == "if"


@pytest.mark.parametrize("text", ["x", "package p\nfunc f() { if { } }", "package p\nfunc f() {", "package p\nfunc f() { x = }", "package p\ntype T struct { a b c }", "package p\nvar a = #", "package p func f() {}"])
def test_what_is_no_go(text):
    with pytest.raises(golang.Unreadable):
        golang.read(text)


def test_unused_inputs(spark):
    src = "package p\nfunc Run(a, b int, c func(d string) error, _ bool, e ...T) (f int) { x.a = b; g := func(b int) { _ = c }; g(1); return }\nfunc hidden(z int) {}\nfunc Types(int, string) {}\nfunc Extern(q int)\n"
    found = golang.routines(golang.facts(spark.createDataFrame([("a.go", src)], "path string, content string")))
    assert [(r.operation, r.parameter, r.adverse) for r in golang.unused_inputs(found).orderBy("parameter").collect()] == [("Run", "a", 0.25), ("Run", "e", 0.25)]
    assert {r.fn: r.parameters for r in found.collect()} == {"Run": 5, "hidden": 1, "Types": 2, "Extern": 1}
