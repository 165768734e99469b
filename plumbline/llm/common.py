"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}
#: Scratch paths of the scopes that are open, by thread.
_OPEN = threading.local()

#: Bytes of a table, as its values are counted, that may be broadcast.
BROADCAST_BYTES = 32 << 20
#: A key is hot if it has more than this share of all rows, so at most 1,000 keys are, and at least
#: so many rows.
HOT_SHARE, HOT_ROWS = 1e-3, 5_000


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the session has in ``spark.checkpoint.dir``.  Where that is unset, a
    temporary folder stands in, but only in local mode: on a cluster a machine-local
    folder would not be seen by the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if master not in _LOCAL_SCRATCH:
        folder = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_SCRATCH[master] = "file://" + folder
    return _LOCAL_SCRATCH[master]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    getattr(_OPEN, "paths", []).append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession, keep: list[str]) -> Iterator[None]:
    """At its end all scratch paths that this thread made within it are deleted but those of ``keep``."""
    outer, _OPEN.paths = getattr(_OPEN, "paths", []), []
    try:
        yield
    finally:
        made, _OPEN.paths = _OPEN.paths, outer
        outer += keep
        for path in set(made) - set(keep):
            drop_path(spark, path)


def materialize(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: this cuts the
    lineage and survives the loss of executors.  The path is appended to ``made``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that no plan refers to any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def size_in_bytes(df: DataFrame) -> int:
    """Bytes of the values of ``df``, counted over all rows: fixed widths, and the lengths of strings
    and binaries; tables with arrays or maps are not counted so."""
    fixed, varying = 0, []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            varying.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)))
        elif kind.startswith(("array", "map")):
            raise ValueError(f"{f.name} has no fixed width")
        fixed += 8 + 8 * kind.count(",")
    row = sum(varying, F.lit(fixed))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its values have at most ``max_bytes`` (they are counted, over all
    rows), else with a hint to shuffle.  ``df`` should be a written table: it is read once for the count."""
    small = size_in_bytes(df) <= (BROADCAST_BYTES if max_bytes is None else max_bytes)
    return F.broadcast(df) if small else df.hint("merge")


def join_by_hot_key(rows: DataFrame, keyed: DataFrame, key: str, n: str = "n", total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row a key and in ``n`` how many rows have it.

    Keys with more than ``HOT_SHARE`` of all rows (at most 1,000, by what the share is) are joined
    by broadcast, so no task gets a hot key whole; all others are shuffled.  ``keyed`` should be a
    written table.  ``total`` is a bound of all rows, if it is known.
    """
    if total is None:
        total = keyed.agg(F.sum(n)).first()[0] or 0
    most = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = keyed.where(F.col(n) > most)
    if total <= most or hot.isEmpty():
        return rows.join(keyed, key)
    few = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(few, key, "left_anti").join(keyed.where(F.col(n) <= most), key))


def join_counted(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed`` (one row a key) for keys of which some may have a large share of the rows: these
    are counted first, each task adding up its own, and then joined by :func:`join_by_hot_key`."""
    (n,) = spare(rows.join(keyed.limit(0), key), "n")
    counted = materialize(keyed.join(rows.groupBy(key).agg(F.count("*").alias(n)), key), "counted")
    return join_by_hot_key(rows, counted, key, n).drop(n)


@contextmanager
def sized_shuffles(spark: SparkSession, rows: int, each: int = 100_000) -> Iterator[None]:
    """Within it a shuffle has a partition for each ``each`` of ``rows`` narrow rows, but never more than the
    session's own number, which is put back behind it.  Only for what is run within."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(1, min(int(before), -(-rows // each)))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def wide_batches(spark: SparkSession, rows: int = 50_000) -> Iterator[None]:
    """Within it narrow rows go to Python workers by ``rows``; only for what is run within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def row_key(id_: str = "doc_id", *others: str) -> Column:
    """A key of a row: its id, which may be null or repeated, and a hash of ``others`` (else the text).
    Rows that share a key are equal in all of them.  Nulls within keys are equal."""
    return F.struct(F.col(id_).cast("long").alias("doc_id"), F.xxhash64(*(others or ("text",))).alias("rid"))


def drop_positions(parts: Column, gone: Column) -> Column:
    """``parts`` without those at the sorted distinct positions ``gone``, in time linear in both."""
    n = F.size(gone)
    start = lambda k: F.when(k == 0, 0).otherwise(F.get(gone, k - 1) + 1)
    end = lambda k: F.when(k == n, F.size(parts)).otherwise(F.get(gone, k))
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(parts, start(k) + 1, F.greatest(F.lit(0), end(k) - start(k)))))


def numbered(df: DataFrame, *order: Column | str) -> tuple[DataFrame, int]:
    """``df`` with its ``place`` from 1 on in ``order``, and how many rows there are.  Rows are sorted by ranges, written,
    and numbered within each; the driver adds up one count for each range."""
    (at,) = spare(df, "at")
    rows = materialize(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "sorted")
    part, within = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    before, total = [], 0
    for p, n in sorted(tuple(r) for r in rows.groupBy(part).count().collect()):
        before.append((p, total))
        total += n
    (key, first) = spare(rows, "part", "first")
    offsets = df.sparkSession.createDataFrame(before, f"{key} long, {first} long")
    out = rows.withColumn(key, part).join(F.broadcast(offsets), key)
    return out.select(*[f"`{c}`" for c in df.columns], (F.col(first) + within + 1).alias("place")), total


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers by 1,000 rows and 8 MB instead of Spark's 10,000 and 64, unless the session
    has numbers of its own: a batch is held in the JVM and, twice, in Python."""
    key, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")
    if spark.conf.get(size).rstrip("b") == str(64 << 20):
        spark.conf.set(size, str(8 << 20))


def without_rows(docs: DataFrame, keys: DataFrame, *others: str) -> DataFrame:
    """``docs`` without the rows whose :func:`row_key` is in the written table ``keys(key)``."""
    (name,) = spare(docs, "key")
    keyed = docs.withColumn(name, row_key("doc_id", *others))
    return keyed.join(broadcast_if_small(keys.select(F.col("key").alias(name))), name, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release_memory() -> None:
    """At the end of a Python task: give back what its batches took, as the worker stays."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
