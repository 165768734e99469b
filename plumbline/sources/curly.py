"""Syntax trees of Java, Rust and TypeScript routines, read from tokens.

The bodies are those that ``operations.find`` finds.  There is no grammar of types behind this: statements are told
apart by their words, conditions by their operators, and all else is an expression with what it calls and nests.
A body that doesn't come out even is a failure of its routine alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import operations
from .lexer import lex

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: Words that begin a statement of their own, wherever the one before ends.
_STATEMENTS = frozenset("if while for loop do switch match try return throw break continue".split())


class Uneven(ValueError):
    """A body whose brackets or statements don't end."""


class _Reader:
    def __init__(self, tokens: list[tuple], first: int, last: int, language: str):
        self.t, self.i, self.last, self.rust = tokens, first, last, language == "rust"
        self.bare = False  # in the head of a Rust statement a brace opens its body

    def text(self, ahead: int = 0) -> str:
        at = self.i + ahead
        return self.t[at][1] if at < self.last and self.t[at][0] in ("identifier", "operator") else "" if at >= self.last else "\0"

    def got(self, text: str) -> bool:
        if self.text() == text:
            self.i += 1
            return True
        return False

    def take(self, text: str) -> None:
        if not self.got(text):
            raise Uneven(f"{text} wanted at token {self.i}")

    def at(self) -> str:
        return str(self.t[min(self.i, self.last - 1)][3]) if self.last else "0"

    # statements

    def statements(self) -> list[dict]:
        out: list[dict] = []
        while self.i < self.last and self.text() != "}" and not (self.text() in ("case", "default") and not self.rust and self.text(1) not in ("(", ".", "=")):
            before = self.i
            out += self.statement()
            if self.i == before:
                raise Uneven(f"no statement at token {self.i}")
        return out

    def block(self) -> list[dict]:
        self.take("{")
        bare, self.bare = self.bare, False
        out = self.statements()
        self.bare = bare
        self.take("}")
        return out

    def body(self) -> list[dict]:
        return self.block() if self.text() == "{" else self.statement()

    def statement(self) -> list[dict]:
        at, word = self.at(), self.text()
        if self.got(";") or self.got(","):
            return []
        if word == "{":
            return [{"kind": "block", "at": at, "body": self.block()}]
        if word in _STATEMENTS and self.text(1) not in (".", ":", "="):
            self.i += 1
            return getattr(self, word + "_")(at)
        labeled = self.t[self.i][0] == "lifetime" and self.i + 2 < self.last and self.t[self.i + 2][1] == ":"
        if labeled or (self.t[self.i][0] == "identifier" and self.text(1) == ":" and self.text(2) in ("for", "while", "do", "loop", "{", "switch")):
            self.i += 3 if labeled else 2
            return self.statement()
        return self.linear(at)

    def linear(self, at: str, kind: str = "linear") -> list[dict]:
        before, e = self.expression()
        out = [*before, {"kind": kind, "at": at, "expressions": [e] if e else []}]
        if self.rust and self.got("else"):  # a pattern that may not fit
            out.append({"kind": "if", "at": at, "condition": {"kind": "other"}, "body": self.block()})
        self.got(";")
        return out

    def head(self) -> tuple[list[dict], dict | None]:
        """The condition of a statement: in round brackets, or up to its body."""
        if not self.rust:
            self.take("(")
            out = self.expression()
            self.take(")")
            return out
        bare, self.bare = self.bare, True
        out = self.expression()
        self.bare = bare
        return out

    def if_(self, at: str) -> list[dict]:
        before, test = self.head()
        out = {"kind": "if", "at": at, "condition": test or {"kind": "other"}, "body": self.body()}
        if self.got("else"):
            out["else"] = self.body()
        return [*before, out]

    def while_(self, at: str) -> list[dict]:
        before, test = self.head()
        return [*before, {"kind": "loop", "at": at, "condition": test or {"kind": "other"}, "body": self.body()}]

    def loop_(self, at: str) -> list[dict]:
        return [{"kind": "loop", "at": at, "body": self.block()}]

    def do_(self, at: str) -> list[dict]:
        body = self.body()
        self.take("while")
        before, test = self.head()
        self.got(";")
        return [{"kind": "loop", "at": at, "condition": test or {"kind": "other"}, "body": body + before}]

    def for_(self, at: str) -> list[dict]:
        if self.rust:
            while self.i < self.last and not self.got("in"):
                self.i += 1
            before, over = self.head()
            return [*before, {"kind": "loop", "at": at, "condition": over, "may_skip": True, "body": self.body()}]
        self.got("await")
        self.take("(")
        parts: list[tuple] = [self.expression()]
        while self.got(","):
            parts[0] = self.expression()
        if self.got(":"):
            parts = [self.expression()]
        while self.got(";"):
            parts.append(self.expression())
        self.take(")")
        first = [{"kind": "linear", "at": at, "expressions": [parts[0][1]]}] if parts[0][1] else []
        if len(parts) == 1:
            return [*parts[0][0], {"kind": "loop", "at": at, "condition": parts[0][1], "may_skip": True, "body": self.body()}]
        body = self.body()
        if len(parts) > 2 and parts[2][1]:
            body = [*body, {"kind": "linear", "at": at, "expressions": [parts[2][1]]}]
        out = {"kind": "loop", "at": at, "body": body}
        if parts[1][1]:
            out["condition"] = parts[1][1]
        return [*first, out]

    def switch_(self, at: str) -> list[dict]:
        before, on = self.head()
        self.take("{")
        cases = []
        while not self.got("}"):
            default, tests = self.got("default"), []
            if not default:
                self.take("case")
                tests.append(self.expression(stop=("->",))[1])
                while self.got(","):
                    tests.append(self.expression(stop=("->",))[1])
            if self.got("->"):
                cases.append({"default": default, "expressions": [x for x in tests if x], "body": self.body()})
                continue
            self.take(":")
            body = self.statements()
            ends = bool(body) and body[-1]["kind"] in ("break", "return", "panic", "continue")
            cases.append({"default": default, "falls_through": not ends and self.text() in ("case", "default"), "expressions": [x for x in tests if x], "body": body})
        return [*before, {"kind": "switch", "at": at, "condition": on, "cases": cases}]

    def match_(self, at: str) -> list[dict]:
        before, on = self.head()
        self.take("{")
        bare, self.bare = self.bare, False
        cases = []
        while not self.got("}"):
            self.got(",")
            if self.got("}"):
                break
            default = self.text() == "_" and self.text(1) == "=>"
            guard = None
            while self.i < self.last and self.text() not in ("=>", "if"):
                self.skip()
            if self.got("if"):
                guard = self.expression(stop=("=>",))[1]
            self.take("=>")
            cases.append({"default": default, "expressions": [guard] if guard else [], "body": self.body()})
        self.bare = bare
        return [*before, {"kind": "switch", "at": at, "condition": on, "cases": cases}]

    def try_(self, at: str) -> list[dict]:
        out = []
        if not self.rust and self.text() == "(":
            before, held = self.head()
            out += [*before, {"kind": "linear", "at": at, "expressions": [held] if held else []}]
        out.append({"kind": "block", "at": at, "body": self.block()})
        while self.text() == "catch":
            where = self.at()
            self.i += 1
            if self.text() == "(":
                self.skip()
            out.append({"kind": "if", "at": where, "condition": {"kind": "other"}, "body": self.block()})
        if self.got("finally"):
            out.append({"kind": "block", "at": at, "body": self.block()})
        return out

    def return_(self, at: str) -> list[dict]:
        return self.linear(at, "return")

    def throw_(self, at: str) -> list[dict]:
        return self.linear(at, "panic")

    def jump(self, at: str, kind: str) -> list[dict]:
        labeled = self.i < self.last and (self.t[self.i][0] == "lifetime" or (self.t[self.i][0] == "identifier" and not self.rust and self.text(1) == ";"))
        if labeled:
            self.i += 2 if self.t[self.i][0] == "lifetime" else 1
        before, value = self.expression() if self.rust else ([], None)
        self.got(";")
        return [*before, {"kind": kind, "at": at, "labeled": labeled, "expressions": [value] if value else []}]

    def break_(self, at: str) -> list[dict]:
        return self.jump(at, "break")

    def continue_(self, at: str) -> list[dict]:
        return self.jump(at, "continue")

    # expressions

    def skip(self) -> None:
        """One token, or all between two brackets."""
        depth = 0
        while self.i < self.last:
            text = self.text()
            depth += (text in _OPEN) - (text in _CLOSE)
            self.i += 1
            if depth <= 0:
                return
        raise Uneven("a bracket that isn't closed")

    def expression(self, stop: tuple[str, ...] = ()) -> tuple[list[dict], dict | None]:
        """(statements within it that come before, tree) up to what can't belong to it; nothing if that comes at once."""
        before: list[dict] = []
        tree = self.choice(before, stop)
        return before, tree

    def choice(self, before: list[dict], stop: tuple[str, ...]) -> dict | None:
        test = self.either(before, stop, "||", "or", lambda: self.either(before, stop, "&&", "and", lambda: self.chain(before, stop)))
        if test and self.chooses():
            self.i += 1
            yes = self.choice(before, (*stop, ":"))
            if not self.got(":"):
                raise Uneven("a choice without its other side")
            return {"kind": "conditional", "children": [test, yes or {"kind": "other"}, self.choice(before, stop) or {"kind": "other"}]}
        return test

    def either(self, before: list[dict], stop: tuple[str, ...], sign: str, kind: str, part) -> dict | None:
        left = part()
        while left and self.text() == sign and sign not in stop:
            self.i += 1
            left = {"kind": kind, "children": [left, part() or {"kind": "other"}]}
        return left

    def chain(self, before: list[dict], stop: tuple[str, ...]) -> dict | None:
        """Operands and operators of no account here, to the next one that is."""
        parts: list[dict] = []
        calls: list[str] = []
        nested: list[dict] = []
        first = self.i
        while self.i < self.last:
            text, kind = self.text(), self.t[self.i][0]
            if text in stop or text in (";", ",", ":", ")", "]", "}", "&&") and not (text == ":" and (self.typed() or self.arrow())) or self.chooses():
                break
            if text == "||" and not (self.rust and self.i == first):
                break
            if text == "{" and self.bare:
                break
            if text in ("else", "case", "catch", "finally") or (not self.rust and self.i > first and text in _STATEMENTS and self.t[self.i - 1][1] != "." and text not in ("match", "loop", "switch")):
                break
            if self.rust and text in ("if", "match", "loop", "while", "for", "return", "break", "continue"):
                before += self.statement()
                continue
            if text == "switch" and self.text(1) == "(" and not self.rust:
                before += self.statement()
                continue
            if text == "!" and self.text(1) != "=" and (self.i == first or (self.t[self.i - 1][0] == "operator" and self.t[self.i - 1][1] not in (")", "]", "}"))):
                self.i += 1
                inner = self.chain(before, stop)
                parts.append({"kind": "not", "children": [inner or {"kind": "other"}]})
                continue
            if text == "{":
                parts += self.braces(before, nested, first)
                if self.rust and self.i < self.last and self.text() not in (".", "?", ")", ",", ";"):
                    break
                continue
            if text in _OPEN:
                if text == "(" and self.i > first and self.t[self.i - 1][0] == "identifier":
                    own = self.i - 2 < first or self.t[self.i - 2][1] not in (".", "::") or self.t[self.i - 3][1] in ("this", "self", "Self")
                    calls += [self.t[self.i - 1][1]] if own else []
                parts += self.brackets(before)
                continue
            if self.rust and text in ("|", "||") and (self.i == first or self.t[self.i - 1][1] in ("(", ",", "=", "move", "return")):
                self.closure(nested)
                continue
            self.i += 1
            if kind == "identifier" and self.rust and text == "unsafe" and self.text() == "{":
                before += self.block()
        if self.i == first:
            return None
        out: dict = {"kind": "other"}
        if len(parts) == 1 and not calls and not nested and parts[0]["kind"] != "other":
            return parts[0]
        return out | {k: v for k, v in (("children", parts), ("calls", calls), ("nested", nested)) if v}

    def chooses(self) -> bool:
        """Whether a question mark is that of a choice, not of a type, a safe access or a default."""
        return not self.rust and self.text() == "?" and self.text(1) not in (".", ":", ")", ",", "?", "]", ";", "=", ">", "") and self.t[self.i - 1][1] not in ("?", "<", ",")

    def typed(self) -> bool:
        """Whether a colon gives the type of a declared name."""
        i = self.i - 1
        return self.t[i][0] == "identifier" and self.t[i - 1][1] in ("let", "const", "var", "mut", "?")

    def arrow(self) -> bool:
        """Whether a colon gives the type of an arrow's result."""
        ahead = [t[1] for t in self.t[self.i + 1 : min(self.i + 12, self.last)]]
        return self.t[self.i - 1][1] == ")" and "=>" in ahead and not {";", "{", "}", "?"} & set(ahead[: ahead.index("=>")])

    def brackets(self, before: list[dict]) -> list[dict]:
        close = _OPEN[self.text()]
        self.i += 1
        bare, self.bare = self.bare, False
        out: list[dict] = []
        while not self.got(close):
            if self.i >= self.last:
                raise Uneven("a bracket that isn't closed")
            at = self.i
            e = self.choice(before, ())
            if e:
                out.append(e)
            if self.i == at or self.text() in (";", ",", ":", "?"):
                if self.text() in _CLOSE and self.text() != close:
                    raise Uneven("brackets that cross")
                if self.text() != close:
                    self.i += 1
        self.bare = bare
        return out

    def braces(self, before: list[dict], nested: list[dict], first: int) -> list[dict]:
        """The body of a function or type within an expression, or a literal."""
        ahead = self.t[self.i - 1][1] if self.i > first else ""
        if self.i + 2 < self.last and self.t[self.i + 2][1] == ":":
            return self.brackets(before)
        if ahead in ("=>", "->", ")") or (self.rust and ahead in ("", "=", "async", "move")):
            if self.rust and ahead in ("", "="):
                before += self.block()
            else:
                nested.append({"name": "", "body": self.block()})
            return []
        return self.brackets(before)

    def closure(self, nested: list[dict]) -> None:
        if not self.got("||"):
            self.take("|")
            while self.i < self.last and not self.got("|"):
                self.skip()
        if self.text() == "{":
            nested.append({"name": "", "body": self.block()})
        else:
            inner, e = self.expression()
            nested.append({"name": "", "body": [*inner, {"kind": "linear", "expressions": [e] if e else []}]})


def body(tokens: list[tuple], first: int, last: int, language: str) -> list[dict]:
    """The tree of the body whose brackets are the tokens ``first`` and ``last``; of an arrow's, an expression."""
    if tokens[first][1] != "{":
        reader = _Reader(tokens, first + 1, last, language)
        before, e = reader.expression()
        return [*before, {"kind": "return", "at": str(tokens[first][3]), "expressions": [e] if e else []}]
    reader = _Reader(tokens, first + 1, last, language)
    out = reader.statements()
    if reader.i != last:
        raise Uneven(f"the body ends at token {reader.i}")
    return out


def routines(files: DataFrame, most_tokens: int | None = None, most: int | None = None) -> DataFrame:
    """(path, fn, ordinal, body, failure) of the operations of ``files(path, language, content)`` in Java, Rust and
    TypeScript; ``body`` is what ``syntax.measure`` reads, null where it is a failure.  No shuffle.

    Files are read whole.  With a bound on tokens or operations a file that goes beyond it also has a failure of its own,
    without ``fn``, so nothing is lost unseen."""

    def one(path: str, language: str, content: bytes) -> Iterator[tuple]:
        if language not in ("java", "rust", "typescript"):
            return
        tokens = lex(content, most_tokens)[0]
        found, _, limited = operations.find(content, language, most_tokens, most)
        if limited:
            yield path, None, None, None, f"read up to {most_tokens} tokens and {most} operations only"
        for ordinal, name, owner, _, _, first, last, _, _ in found:
            fn = f"{owner}.{'<init>' if name in (owner, 'constructor') else name}" if owner else name
            try:
                yield path, fn, ordinal, json.dumps(body(tokens, first, last, language)), None
            except (Uneven, RecursionError, IndexError) as e:
                yield path, fn, ordinal, None, str(e) or type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, k, t in zip(b["path"], b["language"], b["content"]) for r in one(p, k or "", t or b"")]
            yield pd.DataFrame(rows, columns=["path", "fn", "ordinal", "body", "failure"]).astype({"ordinal": "Int32"})

    return files.select(F.col("path").cast("string").alias("path"), "language", F.col("content").cast("binary").alias("content")).mapInPandas(run, "path string, fn string, ordinal int, body string, failure string")


def failures(found: DataFrame) -> DataFrame:
    """(path, failure) of the files of which not all was read."""
    return found.where("failure IS NOT NULL").select("path", "failure")
