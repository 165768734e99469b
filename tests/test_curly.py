"""Trees of Java, Rust and TypeScript routines: complexity that was worked out by hand."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import syntax
from plumbline.sources import curly, golang, operations
from plumbline.sources.lexer import lex


def measured(source, language):
    text = source.encode()
    tokens = lex(text, None)[0]
    out = {}
    for _, name, _, _, _, first, last, _, _ in operations.find(text, language, None, None)[0]:
        b = curly.body(tokens, first, last, language)
        out[name] = (syntax.cyclomatic(b), syntax.cognitive(name, b), syntax.npath(b))
    return out


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("java", "", (1, 0, 1)),
        ("java", "if (a && b || !c) { x(); } else if (d) y(); else { z(); }", (5, 5, 7)),
        ("java", "for (int i = 0, j = 1; i < 3; i++) { if (x) continue; } for (Map.Entry<String, X> e : list) { g(e); } while (a > 0) a--; do { a++; } while (a < 9 && b); return a > 1 ? 2 : 3;", (9, 8, None)),
        ("java", "switch (x) { case 1: a(); break; case 2: case 3: b(); default: c(); } try (R r = o()) { d(); } catch (A | B e) { throw new X(\"}\"); } finally { e(); }", (7, 2, None)),
        ("java", "outer: for (;;) { for (;;) { break outer; } }", (4, 4, None)),
        ("java", "list.forEach(x -> { if (x) f(); }); int[] z = {1, 2}; return switch (k) { case A -> 1; case B, C -> { yield 2; } default -> 3; };", (3, 4, None)),
        ("typescript", "const x: number = a?.b ?? 3; if (a) return b ? 'x' : 'y'; for (const k of ks) { g(k!) } const h = (z): void => { if (z) { f(z, 1) } }; return `}`", (4, 7, None)),
        ("typescript", "try { await this.f(); } catch { log() } switch (k) { case 'a': { return 1 } default: return {a: 1, b: [2, !c]} }", (3, 3, None)),
        ("rust", "match x { 0 => 1, 1 | 2 if y && z => { g(); 3 }, _ => panic!(\"no\") }", (4, 2, None)),
        ("rust", "'a: for x in v.iter() { while let Some(y) = it.next() { if *x > 3 || y { continue 'a; } } } loop { break; } S { a: 1 }.go()?; Some(z)", (8, 9, None)),
        ("rust", "let Some(a) = b else { return 1 }; let z = if a { 1 } else { 2 }; v.map(|q| q + 1).each(|q| { if q > 1 { f(v); } }); json!({ \"a\": 1 })", (3, 6, None)),
    ],
)
def test_known_routines(language, text, want):
    whole = {"java": "class T {{ int f(int a) {{ {} }} }}", "typescript": "function f(a: string) {{ {} }}", "rust": "fn f(x: u8) -> u8 {{ {} }}"}[language].format(text)
    got = measured(whole, language)["f"]
    assert got[:2] == want[:2] and want[2] in (None, got[2])


def test_an_arrow_is_what_it_returns():
    assert measured("export const f = (x: number): number => x > 0 && y ? x * 2 : 0;", "typescript") == {"f": (3, 2, 3)}


def test_rows_and_failures(spark):
    rows = [
        ("a.java", "java", b"class T { T() { if (a) { } } int f() { return 1; } }"), ("b.rs", "rust", b"impl S { fn go(&self) { if a { } } }\nfn bad() { let (a, b): (u8, u8) = c; }"),
        ("c.go", "go", b"func F() { }"), ("d.ts", "typescript", None),
    ]
    df = spark.createDataFrame([(p, k, None if t is None else bytearray(t)) for p, k, t in rows], "path string, language string, content binary")
    found = curly.routines(df)
    assert {(r.path, r.fn): r.failure is None for r in found.collect()} == {("a.java", "T.<init>"): True, ("a.java", "T.f"): True, ("b.rs", "S.go"): True, ("b.rs", "bad"): False}
    got = {(r.path, r.fn): r.cyclomatic for r in syntax.measure(found.where("failure IS NULL")).collect()}
    assert got == {("a.java", "T.<init>"): 2, ("a.java", "T.f"): 1, ("b.rs", "S.go"): 2}


def test_files_are_read_whole(spark):
    """600 methods, and 20 of which each is long; with bounds the loss is a failure."""
    many = "class T {" + "".join(f" int f{i}(int a) {{ return a; }}" for i in range(600)) + "}"
    long = "class T {" + "".join(f" int f{i}(int a) {{ {'a = a + 1; ' * 500} return a; }}" for i in range(20)) + "}"
    files = spark.createDataFrame([("many", "java", many), ("long", "java", long), ("empty", "java", None)], "path string, language string, content string")
    got = curly.routines(files)
    assert {r.path: r.n for r in got.groupBy("path").agg(F.count("body").alias("n")).collect()} == {"many": 600, "long": 20}
    assert curly.failures(got).count() == 0
    cut = curly.routines(files, 20_000, 512)
    assert sorted(r.path for r in curly.failures(cut).collect()) == ["long", "many"]
    assert {r.path: r.n for r in cut.groupBy("path").agg(F.count("fn").alias("n")).collect()}["many"] == 512
    state = golang.coverage(files, curly.failures(cut), ["cyclomatic"], [])
    assert {r.path: r.state for r in state.collect()} == {"many": "failed", "long": "failed", "empty": "complete"}


def test_routines_and_their_failures_are_two_tables(spark):
    """What ``routines`` gives is a table that ``failures`` reads."""
    files = spark.createDataFrame([("a.java", "java", b"class T { int f() { return 1; } }"), ("b.rs", "rust", b"fn bad() { let (a, b): (u8, u8) = c; }")], "path string, language string, content binary")
    found = curly.routines(files)
    assert found.columns == ["path", "fn", "ordinal", "body", "failure"]
    assert [r.path for r in curly.failures(found).collect()] == ["b.rs"]
