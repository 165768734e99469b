"""Operations (functions, methods, constructors, arrows) of sources, found in their tokens alone.

Tokens are written as a string with one letter each, so declarations are regular expressions over
that string; brackets are paired in one pass.  No types are known: what is found is an estimate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexer import lex

# Letters of words and signs that matter to a declaration.
_LETTERS = {
    "func": "F", "fn": "F", "function": "F", "const": "C", "class": "T", "struct": "T", "interface": "T", "trait": "T", "enum": "T", "record": "T", "impl": "I",
    "public": "P", "pub": "P", "export": "P", "protected": "P", "private": "V", "if": "K", "for": "K", "while": "K", "switch": "K", "catch": "K", "match": "K",
    "return": "K", "new": "K", "else": "K", "throw": "K", "loop": "K", "synchronized": "K", "=>": "A", "->": "R", "static": "m", "async": "m", "final": "m", "abstract": "m", "default": "m", "readonly": "m", "override": "m",
}
_SIGNS = "(){}[]<>.=;,:?"
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_CHANGES = {"++", "--", "+=", "-=", "*=", "/=", "%="}
_ARITHMETIC = set("+-*/%&|^")
_NEUTRAL = {("+", "0"), ("-", "0"), ("*", "1"), ("/", "1"), ("*", "0"), ("+", "__empty_string__")}
#: Weight of each kind of evidence for work that an operation hides.
WEIGHTS = {"transform": 2.0, "state": 2.0, "validation": 1.0, "unknown_outcome": 1.0}

SCHEMA = """path string, language string, ordinal int, name string, owner string, params int, exposed boolean, first int, last int,
evidence array<string>, calls array<string>, valid boolean, limited boolean"""


def _shape(tokens: list[tuple]) -> str:
    return "".join(_LETTERS.get(text) or ({"identifier": "i", "number": "n", "string": "s"}.get(kind) or (text if text in _SIGNS else "o")) for kind, text, _, _ in tokens)


def _partners(shape: str) -> dict[int, int]:
    """Position of each bracket's other one; brackets that don't match have none."""
    open_, out = [], {}
    for m in re.finditer(r"[(\[{)\]}]", shape):
        if m[0] in _PAIRS:
            open_.append(m.start())
        elif open_ and _PAIRS[shape[open_[-1]]] == m[0]:
            out[open_[-1]] = m.start()
            out[m.start()] = open_.pop()
    return out


def _owners(shape: str, tokens: list[tuple], pair: dict[int, int]) -> list[tuple[int, int, str, bool]]:
    """(start, end, name, public) of the bodies of types, in order of their start."""
    out = []
    for m in re.finditer(r"([TI])([^{};()]*)\{", shape):
        start = m.end() - 1
        words = [i for i in range(m.start(2), m.end(2)) if shape[i] == "i"]
        if not words or start not in pair:
            continue
        # an implementation's type is what follows "for", else its first word
        behind = [i for i in words if tokens[i - 1][1] == "for"] if m[1] == "I" else []
        outer = [i for i in words if shape.count("<", m.start(2), i) <= shape.count(">", m.start(2), i)]
        at = (behind or outer or words)[0]
        out.append((start, pair[start], tokens[at][1], "P" in shape[max(0, m.start() - 4) : m.start()]))
    return out


def _arguments(shape: str, first: int, last: int, pair: dict[int, int]) -> int:
    """How many there are between two brackets."""
    n, i, angle = 0, first, 0
    while i < last:
        if shape[i] in _PAIRS:
            i = pair.get(i, i)
        elif shape[i] in "<>":
            angle += 1 if shape[i] == "<" else -1
        elif shape[i] == "," and angle <= 0 and i + 1 < last:
            n += 1
        i += 1
    return n + 1 if last > first else 0


def _candidates(shape: str, language: str, pair: dict[int, int]) -> Iterator[tuple[int, int, int]]:
    """(declaration, name, opening bracket or single parameter) in order."""
    if language == "go":
        for m in re.finditer(r"F", shape):
            at = pair.get(m.end(), -2) + 1 if shape[m.end() : m.end() + 1] == "(" else m.end()
            if at > 0 and shape[at : at + 2] == "i(":
                yield m.start(), at, at + 1
    elif language == "rust":
        for m in re.finditer(r"F(i)(?:<[^(){};]*>)?(?=\()", shape):
            yield m.start(), m.start(1), m.end()
    else:
        arrow = r"|C(i)=(?=i A|iA|\()" if language == "typescript" else ""
        for m in re.finditer(rf"F(i)(?=\()|(?<![.KCF])(i)(?=\(){arrow}", shape):
            name = m.start(m.lastindex)
            yield m.start(), name, m.end()


def _body(shape: str, at: int, arrow: bool) -> int:
    """Where the body starts behind the parameters, or -1."""
    m = re.compile(r"(?::[^{};=A]*)?A" if arrow else r"[^{};=AK]*(?=\{)").match(shape, at)
    return m.end() if m else -1


def _evidence(tokens: list[tuple], shape: str, first: int, last: int) -> list[str]:
    text = [t[1] for t in tokens[first:last]]
    kinds, found = shape[first:last], set()
    for i, t in enumerate(text):
        before, after = text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
        unary = t in "+-" and (i == 0 or kinds[i - 1] not in "ins)]")
        if t in _ARITHMETIC and not unary and (t, after) not in _NEUTRAL and not (t in "+*" and (t, before) in _NEUTRAL):
            found.add("transform")
    for m in re.finditer(r"i\.i", kinds):
        after = text[m.end()] if m.end() < len(text) else ""
        neutral = re.match(r"n[;}]", kinds[m.end() + 1 :]) and ((after[:1], text[m.end() + 1]) in _NEUTRAL) and text[m.end() + 1] != ("0" if after[:1] == "*" else "")
        if (after in _CHANGES and not neutral) or (m.start() and text[m.start() - 1] in ("++", "--")):
            found.add("state")
        if after == "=":
            ends = re.search(r"[;}]|$", kinds[m.end() + 1 :])
            value = text[m.end() + 1 : m.end() + 1 + ends.start()]
            if text[m.start() : m.end()] in [value[j : j + 3] for j in range(len(value))] and _ARITHMETIC & set(value):
                found.add("state")
    guards = [i for i, t in enumerate(text) if t in ("if", "switch", "match", "assert") and text[i + 1 : i + 2] not in (["="], [";"])]
    if guards:
        thrown = [i for i, t in enumerate(text) if t in ("throw", "panic") and text[i - 1 : i] != ["."] and i > guards[0]]
        values = re.findall(r"(?:^|\x1f)return\x1f([^;}]*)", "\x1f".join(text))
        if thrown or (len(values) > 1 and values[0] != values[1]):
            found.add("validation")
    return sorted(found)


def _chain(shape: str, tokens: list[tuple]) -> str:
    """The shape with double colons as points: both lead from an owner to its name."""
    return "".join("." if t[1] == "::" else c for c, t in zip(shape, tokens))


def _calls(chain: str, first: int, last: int) -> list[tuple[int, int]]:
    """(first, behind the last) of the tokens of each called name between two tokens."""
    return [(first + c.start(), first + c.end()) for c in re.finditer(r"(?<![.F])(?:i\.)*i(?=\()", chain[first:last])]


def call_spans(source: bytes, language: str, most_tokens: int | None = 20_000, most: int | None = 512) -> list[tuple[int, str, int, list[tuple[int, int]]]]:
    """(ordinal of the operation, called name, its byte offset, (first, last) bytes of each argument) of the calls in the
    operations of a source, in order.  A call whose bracket isn't closed has none."""
    tokens = lex(source, most_tokens)[0]
    shape = _shape(tokens)
    pair, chain, out = _partners(shape), _chain(shape, tokens), []
    byte = lambda i: (tokens[i][3], tokens[i][3] + len((tokens[i][2] or tokens[i][1]).encode("utf-8", "surrogateescape")))
    for ordinal, _, _, _, _, begin, end, _, _ in find(source, language, most_tokens, most)[0]:
        for first, behind in _calls(chain, begin + 1, end):
            close = pair.get(behind)
            if close is None:
                continue
            cuts, i = [behind], behind + 1
            while i < close:
                if shape[i] in _PAIRS:
                    i = pair.get(i, i)
                elif shape[i] == ",":
                    cuts.append(i)
                i += 1
            spans = [(byte(a + 1)[0], byte(b - 1)[1]) for a, b in zip(cuts, [*cuts[1:], close]) if b > a + 1]
            out.append((ordinal, "".join(t[1] for t in tokens[first:behind]), tokens[first][3], spans))
    return out


def find(source: bytes, language: str, most_tokens: int | None = 20_000, most: int | None = 512) -> tuple[list[tuple], bool, bool]:
    """(ordinal, name, owner, params, exposed, first, last, evidence, calls) of each operation, and
    whether the source is lexically valid and was cut at a bound (None: no bound)."""
    tokens, valid, limited = lex(source, most_tokens)
    shape = _shape(tokens)
    pair = _partners(shape)
    types, chain = _owners(shape, tokens, pair), _chain(shape, tokens)
    out, free = [], 0
    for start, name, at in _candidates(shape, language, pair):
        if start < free:
            continue
        close = pair.get(at, -1) if shape[at] == "(" else at
        begin = _body(shape, close + 1, shape[start] == "C") if close >= 0 else -1
        if begin < 0 or begin >= len(shape):
            continue
        if shape[begin] == "{":
            if begin not in pair:
                continue
            end = pair[begin]
        else:
            ends = re.compile(r"[;}]|$").search(shape, begin)
            end, begin = ends.start(), begin - 1
        if most is not None and len(out) >= most:
            limited = True
            break
        owner, public = next(((n, p) for s, e, n, p in reversed(types) if s < start < e), ("", False))
        modifiers = re.search(r"[PVmio<>\[\]]*$", shape[max(0, start - 8) : start])[0]
        if language == "go":
            exposed = tokens[name][1][:1].isupper()
            if start + 1 < name:  # a receiver: its type is the last word
                owner = next((tokens[i][1] for i in range(name - 1, start, -1) if shape[i] == "i"), "")
        elif language == "rust":
            exposed = "P" in modifiers
        else:
            exposed = "V" not in modifiers and ("P" in modifiers or (language == "typescript" and public))
        params = _arguments(shape, at + 1, close, pair) if close > at else int(shape[at] == "i")
        names = sorted({"".join(t[1] for t in tokens[first:last]) for first, last in _calls(chain, begin + 1, end)})
        out.append((len(out), tokens[name][1], owner, params, exposed, begin, end, _evidence(tokens, shape, begin + 1, end), names))
        free = end
    return out, valid, limited


def operations(files: DataFrame, most_tokens: int | None = 20_000, most: int | None = 512) -> DataFrame:
    """Operations of ``files(path, language, content)``, each file on its own and without a shuffle.
    Null content has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")]
        for b in batches:
            for path, language, content in zip(b["path"], b["language"], b["content"]):
                found, valid, limited = find(content or b"", language or "", most_tokens, most)
                yield pd.DataFrame([(path, language, *o, valid, limited) for o in found], columns=names)

    return files.select(F.col("path").cast("string").alias("path"), "language", F.col("content").cast("binary").alias("content")).mapInPandas(run, SCHEMA)


def calls(files: DataFrame, most_tokens: int | None = 20_000, most: int | None = 512) -> DataFrame:
    """(path, caller, name, at, arguments) of the calls in the operations of ``files(path, language, content)``, with places in bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *c[:3], [{"first": x, "last": y} for x, y in c[3]]) for p, k, t in zip(b["path"], b["language"], b["content"]) for c in call_spans(t or b"", k or "", most_tokens, most)]
            yield pd.DataFrame(rows, columns=["path", "caller", "name", "at", "arguments"])

    return files.select(F.col("path").cast("string").alias("path"), "language", F.col("content").cast("binary").alias("content")).mapInPandas(run, "path string, caller int, name string, at int, arguments array<struct<first: int, last: int>>")
