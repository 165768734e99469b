"""Facts of Go sources: routines with their syntax trees, types, and files that can't be read.

A recursive-descent reader of the language without its type checker: names are resolved by spelling alone.
Each file is read for itself where it lies (Arrow batches, no shuffle), and a file that can't be read is a
row of its own and concerns no other.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words of the language, and types that every package has.
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
BUILTIN = frozenset("any bool byte comparable complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr".split())
PRECEDENCE = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
ASSIGN = frozenset(":= = += -= *= /= %= &= |= ^= <<= >>= &^=".split())

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<line>\n)|(?P<comment>//[^\n]*)|(?P<block>/\*.*?\*/)
    |(?P<str>"(?:\\.|[^"\\\n])*"|`[^`]*`|'(?:\\.|[^'\\\n])+')
    |(?P<num>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?|0[bBoO][0-9_]+|[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9_]+)?|\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?)i?)
    |(?P<id>[^\W\d]\w*)
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])""",
    re.VERBOSE | re.DOTALL,
)


#: Contents that a task keeps the facts of, and the bytes of one of them, at most: copies of small files are read once.
KEPT, KEPT_BYTES = 4096, 4096


class Unreadable(ValueError):
    """A source that isn't Go, with the place where that shows."""


def scan(source: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, line, column) of the tokens, with the semicolons that line ends stand for."""
    out: list[tuple[str, str, int, int]] = []
    line, start, at = 1, 0, 0

    def end_line() -> None:
        if out:
            kind, text = out[-1][:2]
            if kind in ("id", "str", "num") or text in ("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"):
                out.append(("op", ";", line, at - start + 1))

    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            raise Unreadable(f"{line}:{at - start + 1}: a character that no token has")
        kind, text = m.lastgroup, m.group()
        if kind == "line" or (kind == "block" and "\n" in text):
            end_line()
        elif kind not in ("space", "comment", "block"):
            out.append(("kw" if kind == "id" and text in KEYWORDS else kind, text, line, at - start + 1))
        breaks = text.count("\n")
        if breaks:
            line, start = line + breaks, at + text.rindex("\n") + 1
        at = m.end()
    end_line()
    out.append(("eof", "", line, at - start + 1))
    return out


def _e(kind: str = "other", children=(), **more) -> dict:
    out: dict = {"kind": kind}
    if children := [c for c in children if c]:
        out["children"] = children
    return out | {k: v for k, v in more.items() if v}


def _tidy(node):
    """A tree without what only the reader needs."""
    if isinstance(node, dict):
        return {k: _tidy(v) for k, v in node.items() if k[0] != "_"}
    return [_tidy(x) for x in node] if isinstance(node, list) else node


class Reader:
    def __init__(self, source: str):
        self.tokens, self.i = scan(source), 0
        self.level = 0  # below zero where a brace opens a block, not a literal
        self.receiver = ""
        self.fields: set[str] = set()
        self.foreign: set[tuple[str, str]] = set()
        self.types: set[str] = set()
        self.named: list[str] = []

    # tokens

    @property
    def text(self) -> str:
        return self.tokens[self.i][1] if self.tokens[self.i][0] not in ("str", "num") else "\0"

    @property
    def kind(self) -> str:
        return self.tokens[self.i][0]

    def at(self) -> str:
        return f"{self.tokens[self.i][2]}:{self.tokens[self.i][3]}"

    def fail(self, wanted: str):
        raise Unreadable(f"{self.at()}: {wanted} wanted, found {self.tokens[self.i][1]!r}")

    def take(self, text: str | None = None, kind: str | None = None) -> str:
        if (text is not None and self.text != text) or (kind is not None and self.kind != kind):
            self.fail(text or kind or "")
        self.i += 1
        return self.tokens[self.i - 1][1]

    def got(self, text: str) -> bool:
        if self.text == text and self.kind in ("op", "kw"):
            self.i += 1
            return True
        return False

    def end(self) -> None:
        if self.text not in (")", "}") and self.kind != "eof":
            self.take(";")

    def name(self) -> str:
        return self.take(kind="id")

    # declarations

    def file(self) -> dict:
        self.take("package")
        out = {"package": self.name(), "imports": [], "functions": [], "types": []}
        self.end()
        while self.kind != "eof":
            if self.got("import"):
                self.group(lambda: out["imports"].append(self.imported()))
            elif self.text == "func":
                out["functions"].append(self.function())
            elif self.got("type"):
                self.group(lambda: out["types"].append(self.declared_type()))
            elif self.got("var") or self.got("const"):
                self.group(self.values)
            else:
                self.fail("a declaration")
            self.end()
        return out

    def group(self, one) -> None:
        if not self.got("("):
            one()
            return
        while not self.got(")"):
            one()
            self.end()

    def imported(self) -> str:
        if self.kind == "id" or self.text == ".":
            self.i += 1
        return self.take(kind="str")[1:-1]

    def values(self) -> list[dict]:
        self.names()
        if self.text not in ("=", ";", ")"):
            self.type()
        return self.expressions() if self.got("=") else []

    def names(self) -> list[str]:
        out = [self.name()]
        while self.got(","):
            out.append(self.name())
        return out

    def declared_type(self) -> dict:
        at, name = self.tokens[self.i], self.name()
        out = {"type": name, "line": at[2], "column": at[3], "kind": "named", "fields": [], "methods": 0}
        if self.text == "[" and self.tokens[self.i + 1][0] == "id" and self.tokens[self.i + 2][1] != "]":
            self.parameters("[", "]")
        self.got("=")
        out["kind"] = {"struct": "struct", "interface": "interface"}.get(self.text, "named")
        before, self.types = self.types, set()
        shape = self.type()
        out["fields"], out["methods"] = (shape or {}).get("fields", []), (shape or {}).get("methods", 0)
        out["refers"], self.types = sorted(self.types - BUILTIN - {name}), before
        return out

    def function(self) -> dict:
        self.fields, self.foreign, self.types, self.receiver = set(), set(), set(), ""
        at = self.tokens[self.i]
        self.take("func")
        owner = ""
        if self.text == "(":
            owner = self.receiver_type()
        name = self.name()
        if self.text == "[":
            self.parameters("[", "]")
        n, results = self.signature()
        inputs, body, has, first = self.named, [], False, self.i
        if self.text == "{":
            body, has = self.block(), True
        stop = self.tokens[self.i - 1]
        used = {t[1] for t, before in zip(self.tokens[first + 1 : self.i], self.tokens[first : self.i]) if t[0] == "id" and before[1] != "."}
        return {
            "name": name, "receiver": owner, "parameters": n, "results": results, "line": at[2], "column": at[3], "end_line": stop[2], "end_column": stop[3] + len(stop[1]),
            "body": body if has else None, "unused": [x for x in inputs if has and x != "_" and x not in used], "fields": sorted(self.fields), "foreign_fields": sorted(".".join(x) for x in self.foreign), "refers": sorted(self.types - BUILTIN - {owner}),
        }

    def receiver_type(self) -> str:
        self.take("(")
        if self.kind == "id" and self.tokens[self.i + 1][1] not in (")", "[", "."):
            self.receiver = self.name()
        self.got("*")
        owner = self.name()
        if self.got("["):
            self.names()
            self.take("]")
        self.got(",")
        self.take(")")
        return owner

    def signature(self) -> tuple[int, int]:
        n, names = self.parameters("(", ")"), self.named
        if self.text == "(":
            results = self.parameters("(", ")")
            self.named = names
            return n, results
        if self.kind == "id" or self.text in ("*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type()
            self.named = names
            return n, 1
        return n, 0

    def parameters(self, opens: str, closes: str) -> int:
        """How many parameters a list has: names where there are any, else types.  The names are in ``named``."""
        self.take(opens)
        n = named = 0
        firsts: list[str] = []
        before = set(self.types)
        while self.text != closes:
            self.got("...")
            first = self.i
            firsts.append(self.tokens[first][1])
            self.type()
            n += 1
            if self.text not in (",", closes):  # what looked like a type was a name
                named = n
                self.got("...")
                meant = set(self.types)
                self.type()
                before |= self.types - meant
            if not self.got(","):
                break
        self.take(closes)
        self.named = firsts if named else []
        if named:  # names were read as types
            self.types -= set(firsts) - before
        return n

    # types

    def type(self) -> dict | None:
        while self.got("*") or self.got("<-") or self.got("~"):
            pass
        out = None
        if self.kind == "id":
            name = self.name()
            if self.got("."):
                name += "." + self.name()
            self.types.add(name)
            if self.text == "[" and self.tokens[self.i + 1][1] != "]" and self.tokens[self.i + 1][0] != "num":
                self.take("[")
                self.type()
                while self.got(","):
                    self.type()
                self.take("]")
        elif self.got("["):
            if not self.got("]"):
                if not self.got("..."):
                    self.inside(self.expression)
                self.take("]")
            self.type()
        elif self.got("map"):
            self.take("[")
            self.type()
            self.take("]")
            self.type()
        elif self.got("chan"):
            self.got("<-")
            self.type()
        elif self.got("func"):
            self.signature()
        elif self.got("struct"):
            out = self.struct()
        elif self.got("interface"):
            out = self.interface()
        elif self.got("("):
            self.type()
            self.take(")")
        else:
            self.fail("a type")
        if self.text == "|" and self.level >= 0:
            while self.got("|"):
                self.type()
        return out

    def struct(self) -> dict:
        self.take("{")
        fields: list[str] = []
        while not self.got("}"):
            if self.kind == "id" and self.tokens[self.i + 1][1] not in (";", "}", ".") and self.tokens[self.i + 1][0] != "str":
                fields += self.names()
                self.inside(self.type)
            else:
                first = self.i
                self.type()
                fields.append(next(t[1] for t in reversed(self.tokens[first : self.i]) if t[0] == "id"))
            if self.kind == "str":
                self.i += 1
            self.end()
        return {"fields": fields}

    def interface(self) -> dict:
        self.take("{")
        n = 0
        while not self.got("}"):
            if self.kind == "id" and self.tokens[self.i + 1][1] == "(":
                self.name()
                self.signature()
                n += 1
            else:
                self.inside(self.type)
            self.end()
        return {"methods": n}

    # statements

    def block(self) -> list[dict]:
        self.take("{")
        level, self.level = self.level, 0
        out = self.statements()
        self.level = level
        self.take("}")
        return out

    def statements(self) -> list[dict]:
        out: list[dict] = []
        while self.text not in ("}", "case", "default") and self.kind != "eof":
            out += self.statement()
            if self.text not in ("}", "case", "default"):
                self.take(";")
        return out

    def statement(self) -> list[dict]:
        at, text = self.at(), self.text if self.kind in ("kw", "op") else ""
        if text in (";", "}"):
            return []
        if text == "{":
            return [{"kind": "block", "at": at, "body": self.block()}]
        if text in ("if", "for", "switch", "select"):
            self.i += 1
            return getattr(self, text + "_")(at)
        if self.got("return"):
            return [{"kind": "return", "at": at, "expressions": [] if self.text in (";", "}") else self.expressions()}]
        if text in ("break", "continue", "goto", "fallthrough"):
            self.i += 1
            labeled = self.kind == "id"
            self.i += labeled
            return [{"kind": "linear" if text == "fallthrough" else text, "at": at, "labeled": labeled, "_falls": text == "fallthrough"}]
        if self.got("go") or self.got("defer"):
            return [{"kind": "linear", "at": at, "expressions": [self.expression()]}]
        if self.got("var") or self.got("const"):
            found: list[dict] = []
            self.group(lambda: found.extend(self.values()))
            return [{"kind": "linear", "at": at, "expressions": found}]
        if self.got("type"):
            self.group(self.declared_type)
            return [{"kind": "linear", "at": at}]
        if self.kind == "id" and self.tokens[self.i + 1][1] == ":" and self.level >= 0:
            self.i += 2
            return [] if self.text == "}" else self.statement()
        return self.simple(at)

    def simple(self, at: str) -> list[dict]:
        left = self.expressions()
        if self.kind == "op" and self.text in ASSIGN:
            self.i += 1
            if self.got("range"):
                return [{"kind": "linear", "at": at, "expressions": left, "_range": self.expression()}]
            return [{"kind": "linear", "at": at, "expressions": left + self.expressions()}]
        if self.got("++") or self.got("--"):
            return [{"kind": "linear", "at": at, "expressions": left}]
        if self.got("<-"):
            return [{"kind": "linear", "at": at, "expressions": left + [self.expression()]}]
        call = left[0]
        if len(left) == 1 and call.get("calls") == ["panic"] and call.get("_plain"):
            return [{"kind": "panic", "at": at, "expressions": call.get("_arguments", [])}]
        return [{"kind": "linear", "at": at, "expressions": left}]

    def clause(self) -> tuple[list[dict], list[dict]]:
        """What stands before a block: a statement and a semicolon, if there are, and the statement behind."""
        level, self.level = self.level, -1
        first: list[dict] = []
        last = [] if self.text in ("{", ";") else self.statement()
        if self.got(";"):
            first, last = last, [] if self.text == "{" else self.statement()
        self.level = level
        return first, last

    @staticmethod
    def condition(statement: list[dict]) -> dict | None:
        return statement[0]["expressions"][0] if statement and statement[0].get("expressions") else None

    def if_(self, at: str) -> list[dict]:
        first, last = self.clause()
        if not last:
            self.fail("a condition")
        out = {"kind": "if", "at": at, "condition": self.condition(last), "body": self.block()}
        if self.got("else"):
            where = self.at()
            out["else"] = self.if_(where) if self.got("if") else [{"kind": "block", "at": where, "body": self.block()}]
        return [*first, out]

    def for_(self, at: str) -> list[dict]:
        level, self.level = self.level, -1
        first: list[dict] = []
        test = post = None
        if self.got("range"):
            test, ranges = self.expression(), True
        else:
            start = [] if self.text in ("{", ";") else self.statement()
            ranges = bool(start) and "_range" in start[0]
            if ranges:
                test = start[0]["_range"]
            elif self.got(";"):
                first = start
                test = None if self.text == ";" else self.condition(self.statement())
                self.take(";")
                post = None if self.text == "{" else self.statement()
            else:
                test = self.condition(start)
        self.level = level
        body = self.block() + (post or [])
        out = {"kind": "loop", "at": at, "body": body}
        if test:
            out["condition"] = test
        if ranges:
            out["may_skip"] = True
        return [*first, out]

    def switch_(self, at: str) -> list[dict]:
        first, last = self.clause()
        types = bool(last) and any(e.get("_types") for e in last[0].get("expressions", []))
        out = {"kind": "switch", "at": at, "cases": self.cases(False)}
        if types:
            return [*first, *last, out]
        if last:
            out["condition"] = self.condition(last)
        return [*first, out]

    def select_(self, at: str) -> list[dict]:
        return [{"kind": "switch", "at": at, "cases": self.cases(True)}]

    def cases(self, communicates: bool) -> list[dict]:
        self.take("{")
        level, self.level = self.level, 0
        out = []
        while not self.got("}"):
            default = self.got("default")
            if not default:
                self.take("case")
            found = [] if default else [e for s in self.statement() for e in s.get("expressions", [])] if communicates else self.expressions()
            self.take(":")
            body = self.statements()
            out.append({"default": default, "falls_through": bool(body) and bool(body[-1].get("_falls")), "expressions": found, "body": body})
        self.level = level
        return out

    # expressions

    def inside(self, one):
        level, self.level = self.level, 0
        out = one()
        self.level = level
        return out

    def expressions(self) -> list[dict]:
        out = [self.expression()]
        while self.got(","):
            out.append(self.expression())
        return out

    def expression(self, least: int = 1) -> dict:
        left = self.unary()
        while self.kind == "op" and PRECEDENCE.get(self.text, 0) >= least:
            op = self.take()
            right = self.expression(PRECEDENCE[op] + 1)
            left = _e({"&&": "and", "||": "or"}.get(op, "other"), [left, right])
        return left

    def unary(self) -> dict:
        if self.kind == "op" and self.text in ("+", "-", "!", "^", "*", "&", "<-", "~"):
            op = self.take()
            if op == "<-" and self.text == "chan":
                self.type()
                return _e()
            return _e("not" if op == "!" else "other", [self.unary()])
        return self.primary()

    def primary(self) -> dict:
        out = self.operand()
        while True:
            if self.got("."):
                if self.got("("):
                    types = self.got("type")
                    if not types:
                        self.inside(self.type)
                    self.take(")")
                    out = _e("other", [out], _types=types)
                else:
                    field, base = self.name(), out.get("_name", "")
                    if base and base == self.receiver:
                        self.fields.add(field)
                    elif base:
                        self.foreign.add((base, field))
                    out = _e("other", [out], _of=base, _field=field, _literal=bool(base))
            elif self.text == "(" and self.kind == "op":
                out = self.call(out)
            elif self.text == "[" and self.kind == "op":
                out = self.index(out)
            elif self.text == "{" and self.kind == "op" and (out.get("_written") or (self.level >= 0 and (out.get("_name") or out.get("_literal")))):
                if out.get("_name"):
                    self.types.add(out["_name"])
                elif out.get("_of"):
                    self.types.add(f"{out['_of']}.{out['_field']}")
                    self.foreign.discard((out["_of"], out["_field"]))
                out = _e("other", [out, *self.elements()])
            else:
                return out

    def call(self, of: dict) -> dict:
        self.take("(")
        arguments: list[dict] = []

        def read() -> None:
            while self.text != ")":
                arguments.append(self.expression())
                self.got("...")
                if not self.got(","):
                    break

        self.inside(read)
        self.take(")")
        calls = [of["_name"]] if of.get("_name") else [of["_field"]] if of.get("_of") and of["_of"] == self.receiver else []
        if of.get("_of") == self.receiver and of.get("_field"):
            self.fields.discard(of["_field"])  # a method of its own
        elif of.get("_of"):
            self.foreign.discard((of["_of"], of["_field"]))
        return _e("other", [of, *arguments], calls=calls, _plain=bool(of.get("_name")), _arguments=arguments)

    def index(self, of: dict) -> dict:
        self.take("[")
        found: list[dict] = []

        def read() -> None:
            while self.text != "]":
                if self.got(":") or self.got(","):
                    continue
                found.append(self.expression())

        self.inside(read)
        self.take("]")
        return _e("other", [of, *found], _literal=bool(of.get("_name") or of.get("_literal")))

    def elements(self) -> list[dict]:
        self.take("{")
        out: list[dict] = []

        def one() -> dict:
            return _e("other", self.elements()) if self.text == "{" and self.kind == "op" else self.expression()

        def read() -> None:
            while self.text != "}":
                first = one()
                out.append(_e("other", [first, one()]) if self.got(":") else first)
                if not self.got(","):
                    break

        self.inside(read)
        self.take("}")
        return out

    def operand(self) -> dict:
        if self.kind in ("str", "num"):
            self.i += 1
            return _e()
        if self.kind == "id":
            return _e(_name=self.name())
        if self.got("("):
            out = self.inside(self.expression)
            self.take(")")
            return {k: v for k, v in out.items() if k not in ("_name", "_literal")} if out.get("_literal") else out
        if self.text == "func":
            self.take("func")
            self.signature()
            if self.text != "{":
                return _e()
            return _e(nested=[{"name": "", "body": self.block()}])
        if self.text in ("[", "map", "chan", "struct", "interface") and self.kind in ("op", "kw"):
            self.type()
            return _e(_literal=True, _written=True)
        self.fail("an expression")
        raise AssertionError


def read(source: str) -> dict:
    """``package``, ``imports``, ``functions`` and ``types`` of a source; :class:`Unreadable` if it isn't Go."""
    return Reader(source).file()


_ROWS = """path string, what string, type string, name string, kind string, line int, column int, end_line int, end_column int, parameters int, results int, methods int,
unused array<string>, fields array<string>, foreign_fields array<string>, refers array<string>, body string, failure string"""
_NAMES = [x.split()[0] for x in _ROWS.replace("\n", " ").split(", ")]


def facts(files: DataFrame) -> DataFrame:
    """A row for each routine, type and unreadable file of ``files(path, content)`` (``what``: routine, type or failure).

    Null contents and such that aren't UTF-8 are failures too.  ``routines``, ``types`` and ``failures`` pick from it;
    write it to a table if more than one is needed."""

    def all_of(content: bytes | None) -> list[dict]:
        try:
            got = read(bytes(content).decode("utf-8-sig"))
        except (Unreadable, UnicodeDecodeError, RecursionError, TypeError, IndexError) as e:
            return [{"what": "failure", "failure": str(e) or type(e).__name__}]
        of = [{**f, "what": "routine", "type": f["receiver"], "body": None if f["body"] is None else json.dumps(_tidy(f["body"]))} for f in got["functions"]]
        return of + [{**t, "what": "type", "name": t["type"]} for t in got["types"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 10_000))
        known = lru_cache(maxsize=KEPT)(all_of)
        try:
            for b in batches:
                found = ((path, known(bytes(c)) if c is not None and len(c) <= KEPT_BYTES else all_of(c)) for path, c in zip(b["path"], b["content"]))
                rows = [{**r, "path": path} for path, of in found for r in of]
                out = pd.DataFrame(rows, columns=_NAMES).astype(object)
                ints = [n for n in _NAMES if n in ("line", "column", "end_line", "end_column", "parameters", "results", "methods")]
                yield out.where(out.notna(), None).astype({n: "Int32" for n in ints})
        finally:
            sys.setrecursionlimit(limit)

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(run, _ROWS)


def routines(found: DataFrame) -> DataFrame:
    """(path, fn, receiver, name, body, ...) as the metrics of syntax trees read them."""
    fn = F.when(F.col("type") == "", F.col("name")).otherwise(F.concat_ws(".", "type", "name"))
    return found.where("what = 'routine'").select("path", fn.alias("fn"), F.col("type").alias("receiver"), "name", "line", "column", "end_line", "end_column", "parameters", "results", "unused", "fields", "foreign_fields", "refers", "body")


def types(found: DataFrame) -> DataFrame:
    return found.where("what = 'type'").select("path", "type", "kind", "line", "column", "fields", "methods", "refers")


def failures(found: DataFrame) -> DataFrame:
    return found.where("what = 'failure'").select("path", "failure")


def unused_inputs(routines_: DataFrame, adverse: float = 0.25) -> DataFrame:
    """(path, kind, operation, parameter, adverse): the parameters of exported routines that their bodies never name, as findings
    for ``shape.finding_penalty``."""
    r = routines_.where(F.col("name").rlike("^[A-Z]"))
    return r.select("path", F.lit("unused_input").alias("kind"), F.col("fn").alias("operation"), F.explode("unused").alias("parameter"), F.lit(adverse).alias("adverse"))


def coverage(files: DataFrame, failed: DataFrame, components: list[str], by_package: list[str]) -> DataFrame:
    """(path, component, state) of ``files(path)``: ``failed`` for each component of an unreadable file; for the
    components ``by_package``, which need all files of a directory, ``unavailable`` where one of them failed; else
    ``complete``."""
    package = F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1)
    bad = failed.select("path").distinct().withColumn("_failed", F.lit(True))
    broken = failed.select(package.alias("_package")).distinct().withColumn("_broken", F.lit(True))
    each = files.select("path").distinct().withColumns({"_package": package, "component": F.explode(F.array(*[F.lit(c) for c in components]))})
    j = each.join(bad, "path", "left").join(broken, "_package", "left")
    state = F.when(F.col("_failed"), "failed").when(F.col("_broken") & F.col("component").isin(by_package), "unavailable").otherwise("complete")
    return j.select("path", "component", state.alias("state"))


def class_facts(found: DataFrame, cyclomatic: DataFrame) -> DataFrame:
    """(path, type, wmc, atfd, tcc, cbo) of the structs and interfaces of a package's files, by ``cyclomatic(path, fn, cyclomatic)``.

    Methods belong to the type of their receiver in the same directory.  Foreign data are fields reached through
    other names than the receiver's, cohesion is in percent, and coupling counts the types that the type and its
    methods name."""
    package = F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1).alias("package")
    r = routines(found).join(cyclomatic, ["path", "fn"], "left").withColumn("package", package).where("receiver <> ''")
    t = types(found).withColumn("package", package).where("kind IN ('struct', 'interface')")
    own = r.groupBy("package", F.col("receiver").alias("type")).agg(F.sum("cyclomatic").alias("wmc"), F.size(F.array_distinct(F.flatten(F.collect_list("foreign_fields")))).alias("atfd"), F.collect_list("refers").alias("named"))
    use = r.select("package", F.col("receiver").alias("type"), "name", F.explode("fields").alias("field")).join(t.select("package", "type", F.explode("fields").alias("field")), ["package", "type", "field"], "left_semi").distinct()
    n = r.groupBy("package", F.col("receiver").alias("type")).agg(F.count("*").alias("n"))
    pairs = use.alias("a").join(use.alias("b"), ["package", "type", "field"]).where("a.name < b.name").select("package", "type", F.col("a.name").alias("x"), F.col("b.name").alias("y")).distinct().groupBy("package", "type").agg(F.count("*").alias("c"))
    j = t.join(own, ["package", "type"], "left").join(n, ["package", "type"], "left").join(pairs, ["package", "type"], "left")
    tcc = F.when(F.coalesce("n", F.lit(0)) < 2, 0.0).otherwise(100 * F.coalesce("c", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2))
    others = F.array_remove(F.array_distinct(F.concat("refers", F.coalesce(F.flatten("named"), F.array().cast("array<string>")))), F.col("type"))
    return j.select("path", "type", "kind", (F.coalesce("wmc", F.lit(0)) + F.coalesce("methods", F.lit(0))).cast("long").alias("wmc"), F.coalesce("atfd", F.lit(0)).alias("atfd"), tcc.alias("tcc"), F.size(others).alias("cbo"))
