"""Tree metrics against worked cases and an enumeration of paths; the lexer against a plain scanner."""

import json
import random

from plumbline.operators import syntax
from plumbline.sources import lexer

X = {"kind": "other"}


def op(kind, *children):
    return {"kind": kind, "children": list(children)}


def s(kind, **rest):
    return {"kind": kind, **rest}


# -- every path of a routine, one by one


def truths(e):
    """(value or None, ...) of every way through an expression."""
    if not e:
        return [None]
    kind, parts = e["kind"], e.get("children", [])
    if kind == "not" and parts:
        return [None if v is None else not v for v in truths(parts[0])]
    if kind in ("and", "or"):
        out = []
        for v in ways(parts[0]):
            out += [v] if v == (kind == "or") else truths(parts[1])
        return out
    if kind == "conditional" and len(parts) == 3:
        return [None for v in ways(parts[0]) for _ in truths(parts[1 if v else 2])]
    n = 1
    for p in parts:
        n *= len(truths(p))
    return [None] * n


def ways(e):
    """Outcomes of a condition; one that isn't decided goes both ways."""
    return [w for v in truths(e) for w in ([True, False] if v is None else [v])]


def count(e):
    """Ways through an operand whose value isn't used."""
    if e and e["kind"] in ("and", "or"):
        left = ways(e["children"][0])
        return sum(1 if v == (e["kind"] == "or") else count(e["children"][1]) for v in left)
    if e and e["kind"] == "conditional":
        return sum(count(e["children"][1 if v else 2]) for v in ways(e["children"][0]))
    if e and e["kind"] == "not":
        return count(e["children"][0])
    n = 1
    for p in (e or {}).get("children", []):
        n *= count(p)
    return n


def paths(body):
    """The way each path through a list of statements ends."""
    out = ["next"]
    for t in body:
        out = [e for p in out for e in (step(t) if p == "next" else [p])]
    return out


def step(t):
    kind = t["kind"]
    if kind == "block":
        return paths(t["body"])
    if kind == "if":
        return [e for v in ways(t.get("condition")) for e in paths(t["body"] if v else t.get("else", []))]
    if kind == "loop":
        into = ways(t["condition"]) if t.get("condition") else [True] + [False] * bool(t.get("may_skip"))
        ends = {"next": "loop", "continue": "loop", "break": "next"}
        return [e for v in into for e in ([ends.get(p, p) for p in paths(t["body"])] if v else ["next"])]
    if kind == "switch":
        out, fall = [], []
        for c in t["cases"]:
            inner = [e for _ in ["in", *fall] for e in paths(c["body"])]
            fall = [e for e in inner if e == "next"] if c.get("falls_through") else []
            out += [{"break": "next"}.get(e, e) for e in inner if not (e == "next" and c.get("falls_through"))]
        return out + fall + ["next"] * (not any(c.get("default") for c in t["cases"]))
    if kind in ("break", "continue"):
        return [kind]
    n = 1
    for e in t.get("expressions", []):
        n *= count(e)
    return [kind if kind in ("return", "panic") else "return" if kind == "goto" else "next"] * n


def random_expression(r, depth):
    kind = r.choice(["other", "other", "and", "or", "not", "conditional"]) if depth else "other"
    n = {"other": 0, "not": 1, "conditional": 3}.get(kind, 2)
    return op(kind, *[random_expression(r, depth - 1) for _ in range(n)])


def random_body(r, depth):
    out = []
    for _ in range(r.randrange(3)):
        kind = r.choice(["linear", "if", "loop", "switch", "block", "return", "panic", "break", "continue", "goto"]) if depth else "linear"
        t = s(kind)
        if kind in ("if", "loop"):
            t["condition"] = random_expression(r, 2)
        if kind == "loop" and r.random() < 0.5:
            t["condition"], t["may_skip"] = None, r.random() < 0.5
        if kind in ("if", "loop", "block"):
            t["body"] = random_body(r, depth - 1)
        if kind == "if" and r.random() < 0.5:
            t["else"] = random_body(r, depth - 1)
        if kind == "switch":
            t["cases"] = [{"default": i == 1, "falls_through": r.random() < 0.4, "body": random_body(r, depth - 1)} for i in range(r.randrange(3))]
        if kind in ("linear", "return"):
            t["expressions"] = [random_expression(r, 1)]
        out.append(t)
    return out


def test_paths_are_those_that_one_can_enumerate():
    r = random.Random(7)
    for _ in range(400):
        body = random_body(r, 3)
        assert syntax.npath(body) == sum(e in ("next", "return", "panic", "loop") for e in paths(body)), body


def test_paths_have_no_bound():
    assert syntax.npath([s("if", condition=X, body=[])] * 3000) == 2**3000


def test_cognitive():
    nested = [s("if", condition=X, body=[s("loop", condition=X, body=[s("if", condition=X, body=[])])])]
    assert syntax.cognitive("f", nested) == 1 + 2 + 3
    chain = [s("if", condition=X, body=[], **{"else": [s("if", condition=X, body=[], **{"else": [s("linear")]})]})]
    assert syntax.cognitive("f", chain) == 1 + 1 + 1
    # an else-if charges no level of its own, but what is in it is nested deeper
    assert syntax.cognitive("f", [s("if", condition=X, body=[], **{"else": [s("if", condition=X, body=[s("loop", condition=X, body=[])])]})]) == 1 + 1 + 2
    runs = [s("linear", expressions=[op("and", op("and", X, X), op("or", X, X))])]
    assert syntax.cognitive("f", runs) == 2
    assert syntax.cognitive("f", [s("break", labeled=True), s("goto"), s("linear", expressions=[{"kind": "other", "calls": ["f", "g", "f"]}])]) == 3
    inner = {"kind": "other", "nested": [{"name": "g", "body": [s("if", condition=X, body=[s("linear", expressions=[{"kind": "other", "calls": ["g"]}])])]}]}
    assert syntax.cognitive("f", [s("linear", expressions=[inner])]) == 2 + 1


def test_cyclomatic_and_nested_ifs():
    body = [s("if", condition=op("or", X, X), body=[s("break")]), s("switch", condition=X, cases=[{"default": True, "body": []}, {"body": [s("panic")]}])]
    assert syntax.cyclomatic(body) == 1 + 2 + 1 + 1 + 1
    third = s("if", condition=X, body=[s("if", condition=X, body=[])], at="deep")
    assert syntax.nested_ifs([s("if", condition=X, body=[s("loop", body=[s("if", condition=X, body=[third])])])]) == ["deep"]
    assert syntax.nested_ifs([s("if", condition=X, body=[], **{"else": [s("if", condition=X, body=[], **{"else": [third]})]})]) == []
    assert syntax.nested_ifs([s("if", condition=X, body=[], **{"else": [s("linear"), s("if", condition=X, body=[third])]})]) == ["deep"]


def test_measure_isolates_failures(spark):
    deep = [s("linear")]
    for _ in range(100_000 // 40):
        deep = [s("block", body=deep)]
    rows = [("p", "f", json.dumps([s("if", condition=X, body=[])])), ("p", "g", "{"), ("p", "h", None), ("p", "i", "[]"), ("p", "j", '[{"kind": 1}]'), ("p", "k", '[{}]')]
    df = spark.createDataFrame(rows, "path string, fn string, body string")
    got = {r.fn: r for r in syntax.measure(df).collect()}
    assert (got["f"].cyclomatic, got["f"].cognitive, got["f"].npath, got["f"].failure) == (2, 1, "2", None)
    assert got["g"].failure and got["h"].failure and got["k"].failure and got["h"].npath is None
    assert (got["i"].cyclomatic, got["i"].npath) == (1, "1")
    assert syntax.measure(df.limit(0)).count() == 0


def scan(text):
    """The lexer's rules, a byte at a time, for ASCII."""
    out, i, word = [], 0, lambda c: c.isalnum() or c in "_$"
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif text.startswith("//", i):
            i = (text.find("\n", i) + 1 or len(text) + 1) - 1
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            if end < 0:
                return out, False
            i = end + 2
        elif c == "'" and text[i + 1 : i + 2].isalpha() and not closes(text, i + 1):
            out.append("'")
            i += 1
        elif c in "\"'`":
            j = i + 1
            while j < len(text) and text[j] != c:
                j += 2 if text[j] == "\\" else 1
            if j >= len(text):
                return [*out, "__string__"], False
            out.append("__empty_string__" if j == i + 1 else "__string__")
            i = j + 1
        elif word(c) and not c.isdigit():
            j = i
            while j < len(text) and word(text[j]):
                j += 1
            out.append(text[i:j])
            i = j
        elif c.isdigit():
            j = i + 1
            while j < len(text) and (text[j].isdigit() or text[j] == "." and text[j + 1 : j + 2].isdigit()):
                j += 1
            out.append(text[i:j])
            i = j
        else:
            n = 2 if text[i : i + 2] in lexer.TWO else 1
            out.append(text[i : i + n])
            i += n
    return out, True


def closes(text, j):
    while j < len(text) and (text[j].isalnum() or text[j] == "_"):
        j += 1
    return text[j : j + 1] == "'"


def test_lexer_against_a_scanner():
    r = random.Random(3)
    pieces = ["a", "fn_1", "x$", " ", "\n", "12.5", "3.", "==", "<<=", "->", "/", "*", "// c\n", "/* d */", '"s\\"t"', '""', "'c'", "'life ", "`raw`", "(", "&&", "\\"]
    for _ in range(1500):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(12)))
        found, valid, _ = lexer.lex(text.encode())
        assert ([t[1] for t in found], valid) == scan(text), text


def test_lexer_edges(spark):
    assert lexer.lex(b"/* open") == ([], False, False)
    assert [t[2] or t[1] for t in lexer.lex('é = "ü"'.encode())[0]][-1] == '"ü"'
    assert [t[1] for t in lexer.lex(b"a b c", most=2)[0]] == ["a", "b"] and lexer.lex(b"a b c", most=2)[2] and not lexer.lex(b"a b", most=2)[2]
    df = spark.createDataFrame([("a", bytearray(b"int f(x) { return x + 1; }")), ("b", bytearray(b"int g(y) { return y + 1; }")), ("c", None), ("d", bytearray(b"int g(y) { return y - 1; }"))], "path string, content binary")
    rows = lexer.tokens(df).collect()
    assert [r.text for r in rows if r.path == "a"][:3] == ["int", "f", "("] and not [r for r in rows if r.path == "c"]
    same = {r.path: r.fingerprint for r in lexer.canonical(df).collect()}
    assert same["a"] == same["b"] != same["d"] and len(same) == 4
