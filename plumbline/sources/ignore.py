"""Ignore files: rules of a directory and those above it decide which paths are left out.

The rules are a table, so they may come from any number of directories.  A path is ignored if it,
or a directory on the way to it, is; for each of these the last matching rule counts, where rules of
deeper directories come later.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Named classes of characters.
CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "blank": r"\t ", "cntrl": r"\x00-\x1f\x7f", "digit": "0-9", "graph": "!-~",
    "lower": "a-z", "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": r"\t-\r ", "upper": "A-Z", "xdigit": "0-9A-Fa-f",
}

_PIECE = re.compile(
    r"""\\(?P<escaped>.)|(?P<stars>\*\*+)|(?P<star>\*)|(?P<any>\?)
    |\[(?P<not>[!^]?)(?P<set>\]?(?:\[:[a-z]+:\]|\\.|[^\]\\])*)\]|(?P<bad>[\[\\])|(?P<plain>.)""",
    re.VERBOSE | re.DOTALL,
)
_MEMBER = re.compile(r"\[:(?P<name>[a-z]+):\]|\\(?P<escaped>.)|(?P<range>-)|(?P<plain>.)", re.DOTALL)


def _members(text: str) -> str:
    def one(m: re.Match) -> str:
        if m["name"]:
            return CLASSES[m["name"]]
        return "-" if m["range"] else re.sub(r"([^\w])", r"\\\1", m["escaped"] or m["plain"], flags=re.ASCII)

    return _MEMBER.sub(one, text)


def expression(pattern: str) -> str | None:
    """The regular expression of a pattern without its marks, or None if it is malformed.  It means
    the same in Java and Python."""
    out = []
    for m in _PIECE.finditer(pattern):
        kind = m.lastgroup
        if kind == "bad":
            return None
        if kind == "stars":
            whole = pattern[: m.start()][-1:] in ("", "/") and pattern[m.end() :][:1] in ("", "/")
            last = m.end() == len(pattern)
            out.append(".*" if whole and last else "(?:.*/)?" if whole else "[^/]*")
        elif kind == "star":
            out.append("[^/]*")
        elif kind == "any":
            out.append("[^/]")
        elif m["set"] is not None:
            try:
                # no class takes in the separator
                out.append(f"(?!/)[{'^' if m['not'] else ''}{_members(m['set'])}]")
            except KeyError:
                return None
        else:
            out.append(re.sub(r"([^\w])", r"\\\1", m["escaped"] or m["plain"], flags=re.ASCII))
    text = "".join(out)
    # two stars and the slash behind them are one piece
    text = text.replace(r"(?:.*/)?\/", "(?:.*/)?")
    try:
        re.compile(text)
    except re.error:
        return None
    return text


def rules_of(text: str) -> list[tuple[str, bool, bool]]:
    """(regex, negate, directories only) of the lines of an ignore file, in their order."""
    out = []
    for line in text.split("\n"):
        line = line.removesuffix("\r")
        body = line.rstrip(" ")
        if len(body) < len(line) and (len(body) - len(body.rstrip("\\"))) % 2:
            body += " "  # an escaped blank stays
        negate = body.startswith("!")
        if body.startswith("#") or not body.removeprefix("!"):
            continue
        body = body.removeprefix("!")
        directories = body.endswith("/")
        body = body.removesuffix("/")
        anchored = "/" in body
        regex = expression(body.removeprefix("/"))
        if regex is not None:
            out.append((rf"(?s)\A{'' if anchored else '(?:.*/)?'}{regex}\z", negate, directories))
    return out


def rules(files: DataFrame, project: str = "") -> DataFrame:
    """(base, place, regex, negate, directories) of ignore ``files(path, content)``; ``project`` holds
    further rules of the root, which come after its own.  Paths are relative to the root, whose base is ''."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(base, at + i, *r) for base, at, text in zip(b["base"], b["at"], b["text"]) for i, r in enumerate(rules_of(text or ""))]
            yield pd.DataFrame(rows, columns=["base", "place", "regex", "negate", "directories"])

    own = files.select(F.regexp_replace("path", r"(^|/)[^/]*$", "").alias("base"), F.lit(0).cast("long").alias("at"), F.col("content").cast("string").alias("text"))
    extra = files.sparkSession.createDataFrame([("", 1 << 40, project)], "base string, at long, text string")
    return own.unionByName(extra).mapInPandas(run, "base string, place long, regex string, negate boolean, directories boolean")


def _prefixes(path: Column, whole: bool) -> Column:
    parts = F.split(path, "/")
    n = F.size(parts) if whole else F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def kept(files: DataFrame, table: DataFrame) -> DataFrame:
    """``files(path, ...)`` that the rules of ``table`` don't ignore.

    Every directory is judged once, however many files it holds; a path meets only the rules of the
    directories above it, by equality of the base.  Rows without a path stay.
    """
    path = F.col("path")
    own = files.select(path.alias("node"), F.lit(False).alias("is_dir"))
    above = files.select(F.explode(_prefixes(path, False)).alias("node"), F.lit(True).alias("is_dir"))
    nodes = own.union(above).where("node IS NOT NULL").distinct()
    bases = nodes.select("node", "is_dir", F.explode(F.concat(F.array(F.lit("")), _prefixes(F.col("node"), False))).alias("base"))
    rest = F.when(F.col("base") == "", F.col("node")).otherwise(F.expr("substring(node, length(base) + 2)"))
    hits = bases.join(table, "base").where(F.col("is_dir") | ~F.col("directories")).where(F.regexp_like(rest, F.col("regex")))
    last = hits.groupBy("node", "is_dir").agg(F.max(F.struct(F.length("base").alias("n"), "place", "negate")).alias("r"))
    ignored = last.where("NOT r.negate").select("node", "is_dir")
    way = files.select("path").distinct().select("path", F.explode(F.concat(F.array(F.struct(path.alias("node"), F.lit(False).alias("is_dir"))), F.transform(_prefixes(path, False), lambda d: F.struct(d.alias("node"), F.lit(True).alias("is_dir"))))).alias("s"))
    gone = way.select("path", "s.*").join(ignored, ["node", "is_dir"], "left_semi").select("path").distinct()
    return files.join(gone, "path", "left_anti").select(*files.columns)


def fingerprint(files: DataFrame) -> DataFrame:
    """One row, ``fingerprint``: it changes if any ignore file of ``files(path, content)`` comes, goes or
    changes.  Only hashes are gathered."""
    h = F.sha2(F.concat_ws("\x00", F.col("path"), F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit("").cast("binary")), 256)).cast("binary"), 256)
    return files.select(h.alias("h")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n").cast("binary"), 256).alias("fingerprint"))
