"""Operator 4: line deduplication by a deletion-neighbourhood join.

Two lines are duplicates if they are equal or one edit (a character inserted, deleted or
replaced) apart, after white space at both ends is dropped.  A line is removed if a duplicate
of it comes earlier, in the order of (doc_id, line number); the earlier line counts whether
or not it is removed itself.  Equal lines are found from ``min_chars`` characters on (1: all but blank
lines, which are never removed).  One edit makes another word of a short line, so only lines of
``near_chars`` or more take part in the search for near duplicates.

A line of L characters has L deletion variants, so emitting them for all lines of a corpus
would multiply it by hundreds.  An edit leaves either the first or the last half of the
shorter line as it is.  Lines whose halves no other line shares therefore have no near
duplicate, and only the others emit variants, with the deleted character in the half that was
not shared.  Both filters are exact.

No pairs are made: for each hashed variant a minimum is kept.  Lines with one character
replaced share a variant and the place of the deletion; a line with one character more has the
other line itself as a variant.  In either case all that share are duplicates of the earliest
one, so the earliest is all that any of them needs, and sums by task before the shuffle keep
lines with thousands of copies cheap.  The distance is then verified on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of the shortest line that can repeat, and that can be near another.
MIN_CHARS, NEAR_CHARS = 1, 20
_BASE = 0x9E3779B97F4A7C15


def lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, at, line) of every line of at least ``min_chars`` characters: 128 bits that
    stand for it, its place and its stripped text.  A place is the row's key (an id that may be null
    and comes first then, and a hash of the text) and the number of the line."""
    split = docs.select(common.row_key().alias("key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = F.btrim("line", F.lit(" \t\r\x0b\x0c"))
    split = split.select(F.struct("key.doc_id", "key.rid", "pos").alias("at"), line.alias("line")).where(F.char_length("line") >= min_chars)
    return split.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), "at", "line")


def _halves() -> list[Column]:
    """Hashes of the first and last half of a line, as the shorter or equal line of a pair
    (head0, tail0) and as the longer one (head1, tail1)."""
    n, out = F.char_length("line"), []
    for k in (0, 1):
        m = n - k
        h = F.floor(m / 2).cast("int")
        out.append(F.xxhash64(F.lit("head"), h, F.substr(F.col("line"), F.lit(1), h)).alias(f"head{k}"))
        out.append(F.xxhash64(F.lit("tail"), m, F.substr(F.col("line"), n - (m - h) + 1, m - h)).alias(f"tail{k}"))
    return out


def distinct_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, at, n, chars, head0, tail0, head1, tail1): each distinct line, where it comes first,
    how often it comes, and its length."""
    names = ["head0", "tail0", "head1", "tail1"]
    found = lines(docs, min_chars).select("h1", "h2", "at", F.char_length("line").alias("chars"), *_halves())
    return found.groupBy("h1", "h2").agg(F.min("at").alias("at"), F.count("*").alias("n"), F.min("chars").alias("chars"), *[F.min(x).alias(x) for x in names])


def _powers(n: int, cache: dict = {}) -> np.ndarray:  # noqa: B006
    if len(cache.get("p", ())) < n:
        cache["p"] = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(n, 4096) - 1, _BASE, np.uint64)])
    return cache["p"][:n]


def deletion_hashes(line: str) -> tuple[int, np.ndarray]:
    """Hash of a line, and of each line that is left when one character is deleted; in time
    linear in its length, from polynomial hashes of its prefixes and suffixes."""
    x = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    x = (x + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
    x ^= x >> np.uint64(29)
    p = _powers(len(x) + 1)
    terms = x * p[: len(x)]
    before = np.r_[np.uint64(0), np.cumsum(terms, dtype=np.uint64)]
    shifted = np.r_[np.uint64(0), np.cumsum(x[1:] * p[: max(len(x) - 1, 0)], dtype=np.uint64)]
    tag = np.arange(len(x) + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
    whole = before[-1:] + tag[-1:]
    # without character i: the prefix before i, then characters i + 1 on, each one place lower
    gone = before[: len(x)] + (shifted[-1:] - shifted) + tag[-2:-1]
    mix = lambda h: (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return int(mix(whole).view(np.int64)[0]), mix(gone).view(np.int64)


def near_lines(docs: DataFrame, classes: DataFrame, near_chars: int) -> DataFrame:
    """(h1, h2) of the lines of ``classes`` of at least ``near_chars`` characters that are one edit from an
    earlier such line."""
    classes = classes.where(F.col("chars") >= near_chars)
    sides = F.array(*[F.struct(F.col(f"{side}{k}").alias("half"), F.lit(side == "head").alias("head")) for side in ("head", "tail") for k in (0, 1)])
    halves = classes.select("h1", "h2", F.explode(sides).alias("x")).select("h1", "h2", "x.*")
    shared = halves.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("half")
    survivors = halves.join(shared, "half").groupBy("h1", "h2").agg(F.max("head").alias("head"), F.min("head").alias("only"))
    survivors = common.materialize(survivors.select("h1", "h2", "head", (~F.col("only")).alias("tail")), "survivors")
    # their texts, by another look at the documents
    texts = lines(docs, near_chars).select("h1", "h2", "line")
    if common.size_in_bytes(survivors) <= common.BROADCAST_BYTES:
        texts = texts.join(F.broadcast(survivors), ["h1", "h2"]).groupBy("h1", "h2").agg(*[F.min(x).alias(x) for x in ("line", "head", "tail")])
    else:  # a line that very many documents have is one row a task before it is shuffled
        texts = texts.groupBy("h1", "h2").agg(F.min("line").alias("line")).join(survivors.hint("merge"), ["h1", "h2"])
    texts = common.materialize(texts.join(classes.select("h1", "h2", "at"), ["h1", "h2"]).select("h1", "h2", "at", "line", "head", "tail"), "near-lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            rows = 0
            for i, (line, head, tail) in enumerate(zip(*[batch[c].to_pylist() for c in ("line", "head", "tail")])):
                whole, gone = deletion_hashes(line)
                # where the first half is shared the edit is behind it, and the other way round
                lo = 0 if tail else max(0, (len(line) - 1) // 2 - 1)
                hi = len(gone) if head else min(len(gone), (len(line) + 1) // 2 + 1)
                parts.append((np.r_[whole, gone[lo:hi]], np.r_[-1, np.arange(lo, hi)], i))
                rows += hi - lo + 1
                if rows > 200_000:
                    yield _variant_rows(parts, batch["at"])
                    parts, rows = [], 0
            if parts:
                yield _variant_rows(parts, batch["at"])
        common.release_memory()

    variants = texts.select("at", "line", "head", "tail").mapInArrow(run, "variant long, place int, at struct<doc_id: bigint, rid: bigint, pos: int>")
    # variants that several lines have; the earliest line that is the variant, and that has it
    many = variants.groupBy("variant").agg(F.count("*").alias("n"), F.min(F.when(F.col("place") < 0, F.col("at"))).alias("self"), F.min(F.when(F.col("place") >= 0, F.col("at"))).alias("other")).where("n > 1").drop("n")
    met = common.materialize(variants.join(common.broadcast_if_small(common.materialize(many, "variants")), "variant"), "met")
    same = met.where("place >= 0").groupBy("variant", "place").agg(F.min("at").alias("same"))
    met = met.join(same, ["variant", "place"], "left")
    before = lambda c: F.when(F.col(c) < F.col("at"), F.col(c))
    pick = F.when(F.col("place") < 0, F.array(before("other"))).otherwise(F.array(before("same"), before("self")))
    pairs = met.select("at", F.explode(F.array_compact(pick)).alias("earlier")).distinct()
    known = texts.select("at", "h1", "h2", "line")
    pairs = pairs.join(known, "at").join(known.select(F.col("at").alias("earlier"), F.col("line").alias("other_line")), "earlier")
    return pairs.where(F.levenshtein("line", "other_line", 1) >= 0).select("h1", "h2").distinct()


def _variant_rows(parts: list[tuple], places: pa.Array) -> pa.RecordBatch:
    at = np.repeat([i for _, _, i in parts], [len(v) for v, _, _ in parts])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([v for v, _, _ in parts])), pa.array(np.concatenate([p for _, p, _ in parts]), pa.int32()), places.take(pa.array(at))], ["variant", "place", "at"])


def _dropped(docs: DataFrame, min_chars: int, near_chars: int) -> DataFrame:
    """(key, gone): for each row that loses lines, the numbers of those lines in order."""
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    classes = common.materialize(distinct_lines(docs, min_chars), "lines")
    near = common.materialize(near_lines(docs, classes, max(min_chars, near_chars)), "near")
    bad = classes.select("h1", "h2", "at", "n").join(common.broadcast_if_small(near.withColumn("near", F.lit(True))), ["h1", "h2"], "left").where("n > 1 OR near").select(F.struct("h1", "h2").alias("line"), F.col("at").alias("first"), F.coalesce("near", F.lit(False)).alias("near"), "n")
    bad = common.materialize(bad, "repeated")
    found = lines(docs, min_chars).select(F.struct("h1", "h2").alias("line"), "at")
    # a menu line or a brace may be a large share of all lines
    small = common.size_in_bytes(bad) <= common.BROADCAST_BYTES
    dropped = (found.join(F.broadcast(bad), "line") if small else common.join_by_hot_key(found, bad, "line")).where(F.col("near") | (F.col("at") != F.col("first")))
    return dropped.groupBy(F.struct("at.doc_id", "at.rid").alias("key")).agg(F.array_sort(F.collect_set("at.pos")).alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with duplicate lines taken out of ``text``, and with the numbers of lines before and of
    dropped lines in columns named ``counts``, which ``docs`` mustn't have (``ValueError``).

    A null text stays null and has no lines; an empty one has one, which is kept.  Rows of one
    ``doc_id`` with different texts are documents of their own; rows that repeat both are
    one document, so all get the same result.  Rows without a doc_id come before all others.
    Other columns are passed on, whatever their names.
    """
    if set(counts) & set(docs.columns):
        raise ValueError(f"docs has a column {counts}: name the counts otherwise")
    key, gone = common.spare(docs, "key", "gone")
    dropped = _dropped(docs, min_chars, near_chars).select(F.col("key").alias(key), F.col("gone").alias(gone))
    out = docs.withColumn(key, common.row_key()).join(dropped, key, "left")
    parts, none = F.split("text", "\n"), F.col(gone).isNull()
    kept = F.array_join(common.drop_positions(parts, F.col(gone)), "\n")
    n = {counts[0]: F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"), counts[1]: F.when(none, 0).otherwise(F.size(gone)).cast("long")}
    out = out.withColumns(n).withColumn("text", F.when(none, F.col("text")).otherwise(kept))
    return out.select(*[f"`{c}`" for c in (*docs.columns, *counts)])


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
