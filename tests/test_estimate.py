"""Operations found in small sources of each language, and the estimate over them."""

from plumbline.operators import estimate
from plumbline.sources import operations

GO = b"""package p
// func Hidden() {}
func (s *Store) Put(key string, n int) error {
	if n < 0 { panic("neg") }
	s.total += n
	return helper(key)
}
func helper(k string) error { return nil }
func Run[T any](x T) { }
type F func(int) int
func Add(a, b int) int { return a + b }
"""
JAVA = b"""public class Box<T> extends Base {
  public Box(int a) { this.a = a; }
  private int secret() { return a * 2; }
  public int get(Map<String, Integer> m, int k) { if (k > 0) { return secret(); } return m.get(k); }
  int weak() { new Foo(1); return 0; }
}"""
TS = b"""export function top(a: string, b?: number): string { return a + b }
const inner = (x: number): number => x * 2;
export const one = y => { return y };
export class Svc { constructor(private a: A) {} run() { this.count++; return other(1) } private hid() {} }
"""
RUST = b"""impl<T> Shape for Circle<T> { pub fn area<U>(&self, k: U) -> f64 { self.r * 2.0 } fn inner(&self) {} }
pub fn free() { match x { _ => panic!("no") } }
"""


def named(source, language):
    return {o[1]: (o[2], o[3], o[4], o[7], o[8]) for o in operations.find(source, language)[0]}


def test_operations_of_each_language():
    go = named(GO, "go")
    assert set(go) == {"Put", "helper", "Add"}
    assert go["Put"] == ("Store", 2, True, ["state", "validation"], ["helper", "panic"])
    assert go["helper"][:3] == ("", 1, False) and go["Add"][:4] == ("", 2, True, ["transform"])
    java = named(JAVA, "java")
    assert {k: v[:3] for k, v in java.items()} == {"Box": ("Box", 1, True), "secret": ("Box", 0, False), "get": ("Box", 2, True), "weak": ("Box", 0, False)}
    assert java["secret"][3] == ["transform"] and java["get"][3] == ["validation"] and "secret" in java["get"][4]
    ts = named(TS, "typescript")
    assert {k: v[:3] for k, v in ts.items()} == {"top": ("", 2, True), "inner": ("", 1, False), "one": ("", 1, True), "constructor": ("Svc", 1, True), "run": ("Svc", 0, True), "hid": ("Svc", 0, False)}
    assert ts["run"][3] == ["state"] and ts["run"][4] == ["other"] and ts["inner"][3] == ["transform"]
    rust = named(RUST, "rust")
    assert {k: v[:3] for k, v in rust.items()} == {"area": ("Circle", 2, True), "inner": ("Circle", 1, False), "free": ("", 0, True)}


def test_neutral_operations_are_no_work():
    body = lambda s: named(b"func A(x int) int { " + s + b" }", "go")["A"][3]
    assert body(b"return x + 0") == body(b"return 1 * x") == body(b"return -x") == body(b"return x") == []
    assert body(b"return x - 1") == ["transform"] and body(b"s.n += 0;") == [] and body(b"s.n += 2;") == ["state"] and body(b"s.n = s.n + 1;") == ["state", "transform"]


def test_broken_sources():
    for text in (b"", b"func (", b"func A(", b"func A() {", b"}}}", b"/* x", b"const a = (", b"const a ="):
        for language in ("go", "java", "rust", "typescript", ""):
            assert operations.find(text, language)[0] == []
    found, _, limited = operations.find(b"func A() { }\n" * 600, "go")
    assert len(found) == 512 and limited and len(operations.find(b"func A() { }\n" * 600, "go", most=None)[0]) == 600


def test_estimate(spark):
    deep = b"".join(b"func f%d() { f%d(); x := y * %d; }\n" % (i, i + 1, i + 2) for i in range(8))
    rows = [("a.go", "go", GO), ("b.go", "go", b"func A(x int) { a(); }\nfunc a() { b(); z := q - 4; }\nfunc b() { a(); }"), ("c.go", "go", b"func Top() { f0(); }\n" + deep), ("d.go", "go", b"func hid() { }"), ("e.go", "go", None)]
    ops = operations.operations(spark.createDataFrame([(p, x, None if c is None else bytearray(c)) for p, x, c in rows], "path string, language string, content binary"))
    got = {r.path: (r.burden, r.hidden, r.uncertain) for r in estimate.estimate(ops).collect()}
    # a: Put (1.5) with state and validation, Add (1.5) with a transform
    assert got["a.go"] == (3.0, 5.0, 0.0)
    # b: one transform; the two helpers call each other
    assert got["b.go"] == (1.25, 2.0, 1.25)
    # c: f0 to f3 lie within four calls
    assert got["c.go"] == (1.0, 8.0, 1.0)
    assert set(got) == {"a.go", "b.go", "c.go"}


def test_calls_across_files(spark):
    """Rust: the one operation of another file by owner and name; two candidates are none."""
    rows = [
        ("a.rs", "rust", b"pub fn top() { Store::put(1); Both::go(); near(); }\nfn near() { }"),
        ("b.rs", "rust", b"impl Store { pub fn put(&self, n: i32) { x = n * 7; } }\nimpl Both { fn go(&self) { } }"),
        ("c.rs", "rust", b"impl Both { fn go(&self) { } }"),
        ("d.go", "go", b"func Top() { Store.put(1) }"),
    ]
    ops = operations.operations(spark.createDataFrame([(p, x, bytearray(c)) for p, x, c in rows], "path string, language string, content binary"))
    name = {(r.path, r.ordinal): r.name for r in ops.collect()}
    got = {(r.path, name[r.path, r.caller], r.callee_path, name[r.callee_path, r.callee]) for r in estimate.call_edges(ops).collect()}
    assert got == {("a.rs", "top", "a.rs", "near"), ("a.rs", "top", "b.rs", "put")}
    assert {r.path: r.hidden for r in estimate.estimate(ops).collect()}["a.rs"] == 2.0


def test_a_root_has_so_many_calls(spark):
    wide = b"func Top() { " + b"".join(b"f%02d(); " % i for i in range(70)) + b"}\n" + b"".join(b"func f%02d() { x := y * 2 }\n" % i for i in range(70))
    ops = operations.operations(spark.createDataFrame([("w.go", "go", bytearray(wide))], "path string, language string, content binary"))
    row = estimate.estimate(ops).first()
    assert (row.burden, row.uncertain, row.hidden) == (1.0, 1.0, 128.0)
    assert estimate.estimate(ops, most=100).first().hidden == 140.0


def test_spans_of_arguments(spark):
    text = b'func A(x int) { f("\xc3\xa4, b", g(x, []int{1, 2}), ) ; s.h() }\nfunc B() { A(1 }'
    got = operations.call_spans(text, "go")
    assert [(o, n, [text[a:b].decode() for a, b in spans]) for o, n, _, spans in got] == [(0, "f", ['"ä, b"', "g(x, []int{1, 2})"]), (0, "g", ["x", "[]int{1, 2}"]), (0, "s.h", [])]
    assert all(text[at:].startswith(n.encode()) for _, n, at, _ in got)
    df = spark.createDataFrame([("a.go", "go", bytearray(text)), ("b.go", "go", None)], "path string, language string, content binary")
    assert [(r.name, len(r.arguments)) for r in operations.calls(df).collect()] == [("f", 2), ("g", 2), ("s.h", 0)]
