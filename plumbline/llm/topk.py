"""Operator 8: exact top-k inner-product search by pivot-table elimination.

A table holds for each vector where its distances to many fixed pivots and to the origin place it:
its coordinates in the space that the pivots span, and how far from that space it lies.  They give the
largest lower bound on the distance of a query and a vector that these distances allow (never
less than the triangle inequality over any one pivot), and as 2 q.x = |q|^2 + |x|^2 - |q - x|^2 that is an
upper bound on the score: the product of the coordinates plus the product of the two remainders.
For each query the candidates of a block are taken by falling bound, and the scan of
the block stops when the next bound is below the k-th best score known: no candidate behind
it can take part, so the result is exact.

Queries are written by blocks of bounded size to the shared folder, with their coordinates
and a first k-th score from a bounded sample of vectors.  Every task holds one block
of candidates and reads the query blocks one after another.  Vectors are never joined with
queries and never shuffled; a task returns only scores that reach the known k-th score, so the
final ranking gets few rows more than the result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .records import open_folder

PIVOTS = 48
#: Vectors of each length that pivots and first scores are taken from.
SAMPLE = 2048
#: Queries in memory at once, and candidates of one block.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 16384

_HITS = "query_id long, vec_id long, score long"


def quantized(c: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if the vector is null or holds a null or a
    component that isn't finite."""
    x = F.transform(c, lambda v: v.cast("double"))
    fit = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(c.isNotNull() & fit, F.transform(x, lambda v: F.floor(v * scale)))


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors], np.float64)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Orthonormal rows that span the pivots.  Each next pivot is the vector that lies farthest from the
    space of the origin and those before it."""
    rest, chosen = sample.astype(np.float64), []
    most = np.abs(rest).max(initial=0)
    while len(chosen) < n and len(rest):
        size = np.sqrt((rest * rest).sum(axis=1))
        at = int(size.argmax())
        if not size[at] > 1e-9 * most:
            break
        b = rest[at] / size[at]
        b -= sum((c * (c @ b) for c in chosen), np.zeros_like(b))
        b /= np.sqrt(b @ b)
        chosen.append(b)
        rest = rest - np.outer(rest @ b, b)
    return np.array(chosen).reshape(len(chosen), sample.shape[1])


def place(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates of the rows of ``x`` in the space of the pivots, then their distance from it, which
    is taken large rather than small by what rounding may do."""
    c = x @ basis.T
    n2 = (x * x).sum(axis=1)
    out = np.sqrt(np.maximum(n2 - (c * c).sum(axis=1), 0) + 1e-11 * n2)
    return np.concatenate([c, out[:, None]], axis=1)


class _Scorer:
    """Exact integer scores of rows of ``x`` with a query: by floats while every partial sum is
    below 2**53, else by Python integers."""

    def __init__(self, x: np.ndarray, top: float):
        self.exact = x.size == 0 or np.abs(x).max(initial=0) * top * max(1, x.shape[1]) < 2**53
        self.x = x if self.exact else x.astype(object)

    def __call__(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if self.exact:
            return (self.x[rows] @ q).astype(np.int64)
        whole = [sum(int(a) * int(b) for a, b in zip(r, q)) for r in self.x[rows]]
        return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in whole], np.int64)


def search_block(ids: np.ndarray, x: np.ndarray, cx: np.ndarray, qids: np.ndarray, q: np.ndarray, cq: np.ndarray, floors: np.ndarray, k: int, seen: Counter | None = None):
    """(query ids, vector ids, scores) of a block that reach the top k of their query within it
    and its known k-th score.  ``cx`` and ``cq`` are places against the pivots.  ``seen`` counts pairs,
    and scores that were worked out."""
    norm = np.sqrt((x * x).sum(axis=1)).max(initial=0)
    score = _Scorer(x, np.abs(q).max(initial=0))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 64):
        part = slice(at, at + 64)
        bound = cq[part] @ cx.T
        # room for rounding in the sums of the bound and of the coordinates
        bound += 1e-9 * np.sqrt((q[part] * q[part]).sum(axis=1))[:, None] * norm + 1e-6
        for j in range(len(bound)):
            i = at + j
            kth = floors[i]
            rows = np.flatnonzero((bound[j] >= kth) & (ids != qids[i]))
            if seen is not None:
                seen["pairs"] += int((ids != qids[i]).sum())
            if not len(rows):
                continue
            rows = rows[np.argsort(-bound[j][rows], kind="stable")]
            best_s, best_v = np.empty(0, np.int64), np.empty(0, np.int64)
            step, done = 4 * k, 0
            while done < len(rows) and bound[j][rows[done]] >= kth:
                take = rows[done : done + step]
                take = take[bound[j][take] >= kth]
                done, step = done + step, min(2 * step, 1024)
                s = score(take, q[i])
                if seen is not None:
                    seen["scores"] += len(take)
                best_s, best_v = np.concatenate([best_s, s]), np.concatenate([best_v, ids[take]])
                order = np.lexsort((best_v, -best_s))[:k]
                best_s, best_v = best_s[order], best_v[order]
                if len(best_s) == k:
                    kth = max(kth, best_s[-1])
            fit = best_s >= floors[i]
            if fit.any():
                out.append((np.full(int(fit.sum()), qids[i]), best_v[fit], best_s[fit]))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``vectors(vec_id, embedding)``.

    Queries are the rows where ``is_query`` holds, candidates all rows with another ``vec_id``.
    Null ids and vectors that are null or hold null or non-finite components take no part;
    vectors of different lengths, of which there may be any number, don't score.  Rows that repeat a
    vec_id are candidates each; as queries they are one, the least (shortest, then by components).
    Ties go to the smaller vec_id.  A query without candidates has no row.  Columns of other names
    take no part.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantized(F.col("embedding"), scale).alias("v"), is_query.alias("asks")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    v = v.withColumn("n", F.size("v"))
    pivots, queries = common.scratch_path(spark, "pivots"), common.scratch_path(spark, "queries")

    # about twice SAMPLE vectors of each length by a hash, and of them the least
    sizes = common.materialize(v.groupBy("n").agg(F.count("*").alias("rows")), "lengths")
    chance = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    few = v.select("vec_id", "v", "n").join(common.broadcast_if_small(sizes), "n").where(chance * F.col("rows") < 2 * SAMPLE).groupBy("n", "vec_id").agg(F.min("v").alias("v"))

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(g["v"])
        ids = g["vec_id"].to_numpy(np.int64)
        rows = np.sort(np.random.default_rng(0).permutation(np.argsort(ids))[:SAMPLE])
        return pd.DataFrame({"n": [int(g["n"].iloc[0])], "ids": [ids[rows].tobytes()], "x": [x[rows].tobytes()], "basis": [choose_pivots(x[rows], PIVOTS).tobytes()]})

    few.groupBy("n").applyInPandas(choose, "n int, ids binary, x binary, basis binary").write.partitionBy("n").parquet(pivots)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Pivots(pivots)
        for batch in batches:
            for n, qids, q in _by_length(batch):
                ids, x, basis = known[n]
                cq, cx, floors = place(q, basis), place(x, basis), np.full(len(q), -(2**63), np.int64)
                for found, _, scores in search_block(ids, x, cx, qids, q, cq, np.full(len(q), -np.inf), k):
                    if len(scores) == k:
                        floors[qids == found[0]] = scores[-1]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), n, np.int32)), pa.array(qids), _lists(q.astype(np.int64)), _lists(cq), pa.array(floors)], ["n", "vec_id", "v", "c", "floor"])

    asked = v.where("asks").groupBy("vec_id").agg(F.min(F.struct("n", "v")).alias("q")).select("vec_id", "q.v", "q.n")
    asked.mapInArrow(prepare, "n int, vec_id long, v array<long>, c array<double>, floor long").write.partitionBy("n").option("maxRecordsPerFile", 16 * QUERY_BLOCK).parquet(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Pivots(pivots)
        for n, ids, x in _candidate_blocks(batches):
            cx = place(x, known[n][2])
            for qids, q, cq, floors in _query_blocks(queries, n):
                found = search_block(ids, x, cx, qids, q, cq, floors, k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*found)], ["query_id", "vec_id", "score"])

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = v.select("vec_id", "v", "n").mapInArrow(run, _HITS)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).reshape(-1)))


class _Pivots(dict):
    """(sampled ids, sampled vectors, basis of the pivots) of each length, read when first asked for."""

    def __init__(self, folder: str):
        super().__init__()
        self.folder = folder

    def __missing__(self, n: int):
        rows = [b for b in _read(self.folder, n) if b.num_rows]
        ids, x, basis = (rows[0][c][0].as_py() for c in ("ids", "x", "basis"))
        matrix = lambda b: np.frombuffer(b, np.float64).reshape(-1, max(n, 1)) if n else np.zeros((len(ids) // 8, 0))
        self[n] = np.frombuffer(ids, np.int64), matrix(x), matrix(basis) if n else np.zeros((0, 0))
        return self[n]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) of a batch of ``vec_id``, ``v`` and ``n``, for each length."""
    lengths, ids = batch["n"].to_numpy(zero_copy_only=False), batch["vec_id"].to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield int(n), ids[at], batch["v"].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)


def _candidate_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, vectors) in blocks of about ``CANDIDATE_BLOCK`` rows, of one length each."""
    held: dict[int, list] = {}
    rows = 0

    def blocks():
        for n, parts in held.items():
            yield n, np.concatenate([i for i, _ in parts]), np.concatenate([x for _, x in parts])

    for batch in batches:
        for n, ids, x in _by_length(batch):
            held.setdefault(n, []).append((ids, x))
        rows += batch.num_rows
        if rows >= CANDIDATE_BLOCK:
            yield from blocks()
            held, rows = {}, 0
    yield from blocks()


def _read(folder: str, n: int) -> Iterator[pa.RecordBatch]:
    """The batches of the files of length ``n`` in a shared folder, one at a time; none if there are none."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    filesystem, path = open_folder(f"{folder}/n={n}")
    for info in sorted(filesystem.get_file_info(fs.FileSelector(path, allow_not_found=True)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with filesystem.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(QUERY_BLOCK)


def _query_blocks(folder: str, n: int):
    """(ids, vectors, places, first k-th scores) of the queries of length ``n``, block by block."""
    for b in _read(folder, n):
        if b.num_rows:
            rows = lambda c: b[c].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            yield b["vec_id"].to_numpy(), rows("v") if n else np.zeros((b.num_rows, 0)), rows("c"), b["floor"].to_numpy().astype(np.float64)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(generate_series(1, len(c.v)), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
