"""Operator 9: MinHash near-duplicates with odd sketches.

1. Each document gets ``bands * rows`` MinHash samples of its set of word shingles, one key
   for each band of ``rows`` samples, and an *odd sketch*: a bitmap in which every sample
   flips one bit.  Two sketches differ in about as many bits as the samples differ, so the
   population count of their XOR estimates high similarities precisely.
2. Documents with the same words form a class; only its smallest id goes on.
3. Classes that share a band key are compared by sketch, never as emitted pairs: each block of
   bounded size yields a spanning forest of the pairs that pass.  Their components are groups of
   documents that may be linked.
4. Within each group intersections of the *full* shingle sets are counted exactly by an inverted
   index.  Each block yields a spanning forest of the true links, and their components are
   the result.

Band keys and groups of any size are compared in two rounds (:func:`linked_components`).  First each is cut
into blocks, and two members of it, the same for all its blocks, sit in every block beside the
block's own; a large group of near copies is tied together by them at a cost linear in its size.  Then
only members that are not yet in the group's largest component are set against all others of
the group, again in blocks, which is what makes the result exact.

Two documents at the threshold share no key with probability (1 - t**rows)**bands, and the
sketch test allows five standard deviations; both are below 1e-6 with the defaults.
Shingles are compared as 64-bit hashes (two given sets of 20,000 shingles meet a false match
with a probability below 1e-10).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

BANDS, ROWS, SKETCH_BITS = 48, 6, 1024
#: Documents on either side of a block.
BLOCK = 1024
#: Bytes of the texts in a block of full sets; a block of two rounds has up to twice as many, or two texts.
TEXT_BYTES = 4 << 20
_WORDS_KEPT = 300_000


class _WordHash(dict):
    """64-bit hash of each word, the same in every process; for one task, and emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def split_words(text: str) -> list[bytes]:
    """Words of a text: A-Z lower-cased, cut at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_set(words: list[bytes], size: int, known: _WordHash) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words; of the whole sequence if it
    is shorter; none without words.  ``known`` holds hashes of words met before."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    s = np.full(n, min(size, len(h)), np.uint64)
    for k in range(min(size, len(h))):
        s = (s ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(32)
    return np.unique(_mix(s))


def _constants(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _signature(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    out = None
    for at in range(0, len(s), 2048):
        low = np.multiply.outer(a, s[at : at + 2048]).min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def _odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    bit = _mix(samples + np.arange(len(samples), dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) % np.uint64(bits)
    odd = np.bincount(bit.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def sketch_limit(bands: int, rows: int, bits: int, threshold: float) -> int:
    """XOR bits that a pair at ``threshold`` exceeds with a probability below 1e-6: the expected
    count, plus five standard deviations of the sampled similarity and of the sketch's own
    noise together."""
    k = bands * rows
    flips = 2 * k * (1 - threshold)
    slope = math.exp(-2 * flips / bits)
    p = (1 - slope) / 2
    sampled = 2 * k * math.sqrt(threshold * (1 - threshold) / k) * slope
    return min(bits, math.ceil(bits * p + 5 * math.hypot(sampled, math.sqrt(bits * p * (1 - p)))))


def signatures(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, n_bytes, digest, keys, sketch) of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, known = _constants(bands * rows), _WordHash()
        weights = _constants(rows + 1)[1:]
        for batch in batches:
            n, digests, keys, sketches = [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                words = split_words(text)
                s = shingle_set(words, shingle, known)
                n.append(len(s))
                if not len(s):
                    digests.append(str(doc_id).encode())
                    keys.append(None)
                    sketches.append(None)
                    continue
                samples = _mix(_signature(s, a))
                keys.append(_mix((samples.reshape(bands, rows) * weights).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).astype(np.int64))
                digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                sketches.append(_odd_sketch(samples, bits).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n, pa.int64()), pc.binary_length(batch["text"]).cast(pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                ["doc_id", "n_shingles", "n_bytes", "digest", "keys", "sketch"],
            )
        common.release_memory()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, n_bytes long, digest binary, keys array<long>, sketch binary")


def _groups(batches: Iterator[pd.DataFrame], keys: list[str], pairs: bool) -> Iterator[tuple[bool, pd.DataFrame]]:
    """The groups of two or more rows with equal ``keys`` in a sorted stream of batches.  With ``pairs`` most of those
    of two rows come together, one behind the other, in a frame that is marked as such."""
    held: list[pd.DataFrame] = []
    last = None

    def whole() -> Iterator[tuple[bool, pd.DataFrame]]:
        if sum(map(len, held)) > 1:
            yield False, held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)

    for batch in batches:
        if batch.empty:
            continue
        cols = [batch[k].to_numpy() for k in keys]
        change = np.zeros(len(batch), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is None or tuple(c[0] for c in cols) != last
        last, starts = tuple(c[-1] for c in cols), np.flatnonzero(change)
        if not len(starts):
            held.append(batch)
            continue
        if starts[0]:
            held.append(batch.iloc[: starts[0]])
        yield from whole()
        size = np.diff(starts)
        if pairs and (size == 2).any():
            at = starts[:-1][size == 2]
            yield True, batch.iloc[np.stack([at, at + 1], axis=1).ravel()]
        for k in np.flatnonzero(size > 2 if pairs else size > 1):
            yield False, batch.iloc[starts[k] : starts[k + 1]]
        held = [batch.iloc[starts[-1] :]]
    yield from whole()


def _sketch_forest(sketches: np.ndarray, side: np.ndarray, root: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Spanning forest of the pairs of a block whose sketches are within ``limit``.  In a block of one
    side rows are visited from one to those not yet reached, so a group of near copies costs few
    passes; in one of two sides each row of the first is set against those of the second with
    another root."""
    near = lambda x, rows: rows[np.bitwise_count(sketches[rows] ^ sketches[x]).sum(axis=1) <= limit]
    return _forest(side, root, near)


def _forest(side: np.ndarray, root: np.ndarray, near) -> list[tuple[int, int]]:
    """Spanning forest of the links of a block; ``near(x, rows)`` gives those of ``rows`` that are linked
    with row ``x``."""
    edges: list[tuple[int, int]] = []
    if not side.any():
        rest = np.arange(len(side))
        while len(rest) > 1:
            queue, rest = [int(rest[0])], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                found = near(x, rest)
                if len(found):
                    edges += [(x, int(y)) for y in found]
                    queue += found.tolist()
                    rest = np.setdiff1d(rest, found, assume_unique=True)
        return edges
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for x in left.tolist():
        found = near(x, right[root[right] != root[x]])
        if len(found):
            edges += [(x, int(y)) for y in found]
            # what has been linked is of one root from here on
            root = np.where(np.isin(root, root[found]), root[x], root)
    return edges


class _Sets:
    """Exact links between the rows of a block by an inverted index of their shingle sets."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sizes = np.array([len(s) for s in sets])
        self.percent = percent
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.sizes)
        self.owner, flat = owner[order], flat[order]
        starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
        self.starts, self.length = starts, np.r_[starts[1:], len(flat)].astype(np.int64) - starts
        # the shingles of each row, as runs of the index
        which = np.repeat(np.arange(len(starts), dtype=np.int32), self.length)
        self.runs, self.bounds = which[np.argsort(self.owner, kind="stable")], np.r_[0, np.cumsum(self.sizes)]

    def shared(self, x: int) -> np.ndarray:
        """How many shingles each row shares with row ``x``."""
        mine, got = self.runs[self.bounds[x] : self.bounds[x + 1]], np.zeros(len(self.sizes), np.int64)
        mine = mine[self.length[mine] > 1]
        # by parts, so that the index of a long row isn't spread out at once
        for at in range(0, len(mine), 4096):
            part = mine[at : at + 4096]
            n = self.length[part]
            i = np.repeat(self.starts[part] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            got += np.bincount(self.owner[i], minlength=len(got))
        return got

    def near(self, x: int, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return rows
        both = self.shared(x)[rows]
        return rows[(100 * both >= self.percent * (self.sizes[x] + self.sizes[rows] - both)) & (both > 0)]


_LINK = "a long, b long"


def _edges(ids: np.ndarray, edges: list[tuple[int, int]]) -> pd.DataFrame:
    at = np.array(edges, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": ids[at[:, 0]], "b": ids[at[:, 1]]})


def linked_components(members: DataFrame, payload: DataFrame, comparer, block: int, weight: int) -> DataFrame:
    """(node, root): the components of the links within each key of ``members(key, doc_id, w)``.

    ``payload(doc_id, ...)`` has what a comparison needs: ``comparer()`` is called once a task and gives a function
    ``(block, side, root)`` that finds a spanning forest of the links in a block of rows, and, or None, one that finds
    which of many blocks of two rows, one behind the other, are links.  A key of m rows has as many blocks as keep each near ``block`` rows and
    a ``weight`` of the sum of ``w``; in the second round on either side.  No partner is dropped: two linked members are compared with
    each other unless links found before join them already.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compare, pairs = comparer()
        for two, g in _groups(batches, ["key", "i", "j"], pairs is not None):
            ids, side, root = (g[c].to_numpy() for c in ("doc_id", "side", "root"))
            if two:
                # both on the first side are a block of one side; both on the other aren't compared
                open_ = (ids[::2] != ids[1::2]) & np.where(side[::2] == side[1::2], side[::2] == 0, root[::2] != root[1::2])
                x = 2 * np.flatnonzero(open_ & pairs(g))
                if len(x):
                    yield pd.DataFrame({"a": ids[x], "b": ids[x + 1]})
            elif edges := compare(g, side, root):
                yield _edges(ids, edges)
        common.release_memory()

    def linked(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return dealt.mapInPandas(run, _LINK)

    hashed = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    keys = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.min(hashed).alias("lo"), F.max(hashed).alias("hi")).where("lo <> hi")
    s = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("w") / weight)).cast("int")
    keys = common.materialize(keys.select("key", "n", s.alias("s"), F.col("lo.doc_id").alias("lo"), F.col("hi.doc_id").alias("hi")), "keys")
    chunk = F.pmod(F.xxhash64("doc_id", F.lit("chunk")), F.col("s")).cast("int")
    zero = F.lit(0)
    dealt = common.join_by_hot_key(members.select("key", "doc_id"), keys.select("key", "n", "s"), "key").select("key", "doc_id", "s", chunk.alias("i")).distinct()
    large = keys.where("s > 1")
    one = dealt.select("key", "doc_id", "i").join(payload, "doc_id").withColumns({"j": zero, "side": zero, "root": F.col("doc_id")})
    if large.isEmpty():
        return components(linked(one))
    tied = large.select("key", "s", F.explode(F.array("lo", "hi")).alias("doc_id")).join(payload, "doc_id")
    tied = tied.withColumns({"i": F.explode(F.sequence(zero, F.col("s") - 1)), "j": zero, "side": zero, "root": F.col("doc_id")})

    # members of large keys that the links don't join with most of their key
    root = components(linked(one.unionByName(tied.select(*one.columns))))
    total = large.agg(F.sum("n")).first()[0]
    with common.sized_shuffles(members.sparkSession, total):
        inside = common.join_by_hot_key(members.select("key", "doc_id", "w"), large.select("key", "n", "s"), "key", total=total)
        inside = inside.join(root.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "w", "s", F.coalesce("root", "doc_id").alias("root"))
        inside = common.materialize(inside, "inside")
        most = inside.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
        most = most.groupBy("key").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "root", "w")).alias("main"), F.count("*").alias("roots"))
        t = F.greatest(F.ceil((F.col("n") - F.col("main.n")) / block), F.ceil((F.col("w") - F.col("main.w")) / weight)).cast("int")
        most = common.materialize(most.where("roots > 1").select("key", "n", F.col("main.root").alias("main"), t.alias("t")), "open")
        if most.isEmpty():
            return root
        opened = common.materialize(common.join_by_hot_key(inside, most, "key").select("key", "doc_id", "root", "s", "main", "t", chunk.alias("c")), "opened")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.col("t")).cast("int")
    left = opened.where("root <> main").select("key", "doc_id", "root", F.explode(F.sequence(zero, F.col("s") - 1)).alias("i"), part.alias("j"), zero.alias("side"))
    right = opened.select("key", "doc_id", "root", F.col("c").alias("i"), F.explode(F.sequence(zero, F.col("t") - 1)).alias("j"), F.lit(1).alias("side"))
    return merged(root, linked(left.unionByName(right).join(payload, "doc_id")))


def merged(root: DataFrame, more: DataFrame) -> DataFrame:
    """Components ``root(node, root)`` with the edges ``more(a, b)`` added."""
    more = common.materialize(more, "links")
    return root if more.isEmpty() else components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def candidate_groups(reps: DataFrame, limit: int, block: int = BLOCK) -> DataFrame:
    """(node, root) of the classes in groups that may hold links, from
    ``reps(doc_id, keys, sketch)``."""

    def comparer():
        sketches = lambda g: np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(len(g), -1)

        def pairs(g: pd.DataFrame) -> np.ndarray:
            x = sketches(g)
            return np.bitwise_count(x[::2] ^ x[1::2]).sum(axis=1) <= limit

        return lambda g, side, root: _sketch_forest(sketches(g), side, root, limit), pairs

    members = reps.select(F.explode("keys").alias("key"), "doc_id", F.lit(1).alias("w"))
    return linked_components(members, reps.select("doc_id", "sketch"), comparer, block, 1 << 62)


def links(docs: DataFrame, groups: DataFrame, shingle: int, percent: int, block: int = BLOCK // 2, weight: int = TEXT_BYTES, repeated: DataFrame | None = None) -> DataFrame:
    """(node, root): the components of the true links within each of ``groups(node, root)``; ``n_bytes`` of their texts is
    counted unless ``groups`` has it.  Of ids in the written table ``repeated(doc_id)`` equal rows are one, so that a block has a text
    once, as ``n_bytes`` has."""
    if "n_bytes" not in groups.columns:
        groups = groups.join(docs.groupBy(F.col("doc_id").alias("node")).agg(F.sum(F.octet_length("text")).cast("long").alias("n_bytes")), "node")

    def comparer():
        known = _WordHash()
        return lambda g, side, root: _forest(side, root, _Sets([shingle_set(split_words(t), shingle, known) for t in g["text"]], percent).near), None

    members = groups.select(F.col("root").alias("key"), F.col("node").alias("doc_id"), F.col("n_bytes").alias("w"))
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(common.broadcast_if_small(groups.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi")
    if repeated is not None and not repeated.isEmpty():
        again = common.broadcast_if_small(repeated)
        texts = texts.join(again, "doc_id", "left_anti").unionByName(texts.join(again, "doc_id", "left_semi").distinct())
    return linked_components(members, texts, comparer, block, weight)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each of ``docs(doc_id, text)``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of
    ``shingle``-word shingles; ``component_id`` is the smallest doc_id that links reach.  Null,
    empty and blank texts have no shingles and are linked with nothing.  Rows that repeat a
    ``doc_id`` are one document with several texts: it has the links of all of them, and each row has
    its own ``n_shingles``.  A row without a doc_id is linked with nothing: ``component_id`` is null and
    ``kept`` true.  Columns of other names take no part.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made: list[str] = []
    sig = common.materialize(signatures(docs, shingle, bands, rows, bits), "signatures", made)
    named = sig.where("doc_id IS NOT NULL")
    # copies: a class of equal words is its smallest id (texts without words are told apart)
    classes = named.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("class_id"), F.max("n_shingles").alias("n_shingles"), F.max("n_bytes").alias("n_bytes"), F.min_by(F.struct("keys", "sketch"), "doc_id").alias("rep"))
    classes = common.materialize(classes, "classes")
    # keys and sketches are those of the classes from here on
    sig = common.materialize(sig.select("doc_id", "n_shingles", "digest"), "ids")
    common.drop_path(docs.sparkSession, made[0])
    named = sig.where("doc_id IS NOT NULL")
    reps = classes.where("n_shingles > 0").select(F.col("class_id").alias("doc_id"), "rep.keys", "rep.sketch")
    groups = candidate_groups(reps, sketch_limit(bands, rows, bits, percent / 100))
    sizes = classes.groupBy(F.col("class_id").alias("node")).agg(F.sum("n_bytes").alias("n_bytes"))
    groups = common.materialize(groups.join(sizes, "node"), "groups")
    repeated = named.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").select("doc_id").distinct()
    found = links(docs.where("doc_id IS NOT NULL"), groups, shingle, percent, repeated=common.materialize(repeated, "repeated"))
    # an id with several texts ties their classes together
    several = named.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    ties = named.join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(classes.select("digest", "class_id"), "digest")
    found = merged(found, ties.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")))
    roots = classes.select("digest", "n", "class_id").join(found, F.col("class_id") == F.col("node"), "left")
    roots = common.materialize(roots.select("digest", "n", F.coalesce("root", "class_id").alias("component_id")), "roots")
    out = common.join_by_hot_key(named.select("doc_id", "n_shingles", "digest"), roots, "digest")
    out = out.select("doc_id", "n_shingles", "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept"))
    alone = sig.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80, also: DataFrame | None = None) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of near-duplicates.  Rows
    that repeat a doc_id stay or go together.

    ``also(doc_id, text)`` has further texts of the same documents, such as those they had before lines
    were cut: documents are linked by any of their texts.  Both tables are read several times and should be
    written ones.
    """
    texts = docs.select("doc_id", "text")
    if also is not None:
        # which further texts are wanted is found from ids and hashes alone; only these are read again and written
        hashed = lambda df: df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"))
        ids = common.materialize(hashed(docs).distinct(), "ids")
        wanted = hashed(also).join(ids.select("doc_id").distinct(), "doc_id", "left_semi").join(ids, ["doc_id", "h"], "left_anti").distinct()
        wanted = common.broadcast_if_small(common.materialize(wanted, "wanted"))
        more = also.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
        texts = texts.unionByName(common.materialize(more.join(wanted, ["doc_id", "h"], "left_semi").drop("h"), "texts"))
    dropped = near_duplicates(texts, shingle, percent).where("not kept").select("doc_id").distinct()
    dropped = common.materialize(dropped, "dropped")
    return docs.join(common.broadcast_if_small(dropped), docs["doc_id"] == dropped["doc_id"], "left_anti")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read_table(spark, sf_dir, "documents"), shingle=4, percent=80)


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * both_ >= 80 * (a.n + b.n - both_)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
