"""A lexer for sources of any language: comments go; strings, identifiers, numbers and operators stay."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Operators of two characters, and letters among single bytes.
TWO = ("==", "!=", "<=", ">=", "=>", "++", "--", "+=", "-=", "*=", "/=", "%=", ":=", "&&", "||", "::", "->", "<<", ">>")
_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"

_TOKEN = re.compile(
    rf"""(?P<space>[\t-\r \x85\xa0]+)
    |(?P<comment>//[^\n]*|/\*.*?\*/)
    |(?P<open>/\*)
    |(?P<lifetime>'(?=[{_LETTER}_][{_LETTER}0-9_]*+(?!')))
    |(?P<string>(?P<quote>["'`])(?:\\.|(?!(?P=quote))[^\\])*+(?:(?P<end>(?P=quote))|\\?\Z))
    |(?P<identifier>[{_LETTER}_$][{_LETTER}0-9_$]*)
    |(?P<number>[0-9](?:[0-9]|\.(?=[0-9]))*)
    |(?P<operator>{"|".join(map(re.escape, TWO))}|.)""",
    re.VERBOSE | re.DOTALL,
)

SCHEMA = "path string, pos int, kind string, text string, literal string, offset int, valid boolean, limited boolean"


def lex(source: bytes, most: int | None = 20_000) -> tuple[list[tuple], bool, bool]:
    """Tokens (kind, text, literal, offset) of a source, whether its comments and strings all end,
    and whether it was cut at ``most`` tokens (None: no bound).  Offsets count bytes."""
    out, valid = [], True
    for m in _TOKEN.finditer(source.decode("latin-1")):
        kind, text = m.lastgroup, m.group()
        if m["string"] is not None:
            kind = "string"
        elif m["operator"] is not None:
            kind = "operator"
        if kind in ("space", "comment"):
            continue
        if most is not None and len(out) >= most:
            return out, valid, True
        if kind == "open":
            return out, False, False
        text, literal = text.encode("latin-1").decode("utf-8", "replace") if kind == "identifier" else text, None
        if kind == "string":
            valid &= m["end"] is not None
            literal = text.encode("latin-1").decode("utf-8", "replace")
            text = "__empty_string__" if len(m.group()) == 2 else "__string__"
        out.append((kind, text, literal, m.start()))
    return out, valid, False


def tokens(files: DataFrame, most: int | None = 20_000) -> DataFrame:
    """(path, pos, kind, text, literal, offset, valid, limited) of ``files(path, content)``, where
    content is binary or text.  Null content has no tokens.  Nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "pos", "kind", "text", "literal", "offset", "valid", "limited"]
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                found, valid, limited = lex(content or b"", most)
                yield pd.DataFrame([(path, i, *t, valid, limited) for i, t in enumerate(found)], columns=names)

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInPandas(run, SCHEMA)


KINDS = ("identifier", "number", "string", "operator", "lifetime")


def kinds(files: DataFrame, most: int | None = 20_000) -> DataFrame:
    """``files(path, content, ...)`` without their content, with the number of tokens of each of ``KINDS``.  A row for each file, counted
    where it is read: no token leaves its task and nothing is shuffled."""
    rest = [c for c in files.columns if c != "content"]
    out = ", ".join(f"{k} long" for k in KINDS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            counts = [_counts(content, most) for content in b["content"]]
            yield pd.concat([b[rest], pd.DataFrame(counts, columns=list(KINDS), index=b.index)], axis=1)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*rest).schema.fields), out])
    return files.select(*rest, F.col("content").cast("binary").alias("content")).mapInPandas(run, schema)


def _counts(content: bytes | None, most: int | None) -> list[int]:
    """What ``lex`` gives, counted by kind; token texts aren't made."""
    n, total = dict.fromkeys((*KINDS, "quote"), 0), 0
    for m in _TOKEN.finditer((content or b"").decode("latin-1")):
        kind = m.lastgroup
        if kind in ("space", "comment"):
            continue
        if (most is not None and total >= most) or kind == "open":
            break
        total += 1
        n["string" if m["string"] is not None else kind] += 1
    return [n[k] for k in KINDS]


def canonical(files: DataFrame, most: int | None = 20_000) -> DataFrame:
    """(path, n_tokens, fingerprint): SHA-256 of the tokens with every identifier as ``id``, so that
    bodies that differ by names alone are equal.  One row a file; made where the file is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                found = lex(content or b"", most)[0]
                words = ("id" if kind == "identifier" else text for kind, text, _, _ in found)
                rows.append((path, len(found), hashlib.sha256("\x1f".join(words).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "n_tokens", "fingerprint"])

    return files.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInPandas(run, "path string, n_tokens int, fingerprint string")
