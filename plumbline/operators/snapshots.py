"""Snapshots that are verified while they are written, and a store that keeps each row's content once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Snapshot(NamedTuple):
    """Rows of a table, and the sum of their hashes: equal for the same rows in any order."""

    rows: int
    hashes: int


class SourceChanged(RuntimeError):
    """What was written isn't what was planned."""


def _metrics(df: DataFrame) -> list[Column]:
    # maps have no order, so rows are hashed as JSON with their keys sorted by column
    each = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}))
    return [F.count(F.lit(1)).alias("rows"), F.sum(each.cast("decimal(38,0)")).alias("hashes")]


def snapshot(df: DataFrame) -> Snapshot:
    """The snapshot of a table as it is now."""
    r = df.agg(*_metrics(df)).first()
    return Snapshot(r["rows"], int(r["hashes"] or 0))


def write_verified(df: DataFrame, path: str, planned: Snapshot | None = None) -> Snapshot:
    """Write ``df`` and return the snapshot of what was written, summed up by the tasks that write it, so no row is read again.

    If it isn't ``planned`` the source changed between plan and write: ``SourceChanged``, and nothing stays at ``path``.
    """
    seen = Observation()
    df.observe(seen, *_metrics(df)).write.mode("overwrite").parquet(path)
    got = seen.get
    written = Snapshot(got["rows"], int(got["hashes"] or 0))
    if planned is not None and written != planned:
        _delete(df.sparkSession, path)
        raise SourceChanged(f"{path}: planned {planned.rows} rows, wrote {written.rows}" + (" of other content" if written.rows == planned.rows else ""))
    return written


def _system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _delete(spark: SparkSession, path: str) -> None:
    system, p = _system(spark, path)
    system.delete(p, True)


class ContentStore:
    """Generations of tables in a folder that all executors share; rows of equal content lie on disk once a table.

    ``objects/<n>`` has the rows that generation n brought, by ``digest``; ``lists/<n>`` has the digests of generation n and how often
    each row comes.  A generation counts from when its list is whole; objects without a list are left over from a
    writer that stopped, and are used if their content comes again.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self, table: str, kind: str) -> list[int]:
        system, p = _system(self.spark, f"{self.root}/{table}/{kind}")
        if not system.exists(p):
            return []
        done = lambda s: system.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName()) for s in system.listStatus(p) if s.getPath().getName().isdigit() and done(s))

    def generations(self, table: str) -> list[int]:
        return self._numbers(table, "lists")

    def _objects(self, table: str) -> DataFrame | None:
        parts = [f"{self.root}/{table}/objects/{n}" for n in self._numbers(table, "objects")]
        # after a writer stopped some content may be there twice
        return self.spark.read.parquet(*parts).dropDuplicates(["digest"]) if parts else None

    def put(self, table: str, rows: DataFrame, planned: Snapshot | None = None) -> int:
        """Store ``rows`` as the next generation of ``table``; its number.  Only content that no generation has is written.

        With ``planned`` the rows that the list counts must be those: the list is written last, and ``SourceChanged`` leaves
        the generations as they were.
        """
        n = max([0, *self._numbers(table, "lists"), *self._numbers(table, "objects")]) + 1
        if {"digest", "copies"} & {c.lower() for c in rows.columns}:
            raise ValueError("rows have a column digest or copies")
        columns = sorted(rows.columns)
        json = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"ignoreNullFields": "false"})
        keyed = rows.withColumn("digest", F.sha2(json.cast("binary"), 256))
        once = keyed.groupBy("digest").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("row"))
        known = self._objects(table)
        fresh = once if known is None else once.join(known.select("digest"), "digest", "left_anti")
        fresh.select("digest", "row.*").write.mode("overwrite").parquet(f"{self.root}/{table}/objects/{n}")
        seen = Observation()
        # the rows pass by once more, and what passes is what is compared
        listed = keyed.observe(seen, *_metrics(rows)).groupBy("digest").agg(F.count("*").alias("copies"))
        target, hidden = f"{self.root}/{table}/lists/{n}", f"{self.root}/{table}/lists/_{n}"
        listed.write.mode("overwrite").parquet(hidden)
        got = seen.get
        lost = self.spark.read.parquet(hidden).join(self._objects(table).select("digest"), "digest", "left_anti")
        if (planned is not None and Snapshot(got["rows"], int(got["hashes"] or 0)) != planned) or not lost.isEmpty():
            _delete(self.spark, hidden)
            raise SourceChanged(f"{table}: its rows changed while they were stored")
        system, p = _system(self.spark, hidden)
        if not system.rename(p, _system(self.spark, target)[1]):
            raise RuntimeError(f"generation {n} of {table} could not be published")
        return n

    def get(self, table: str, generation: int | None = None) -> DataFrame:
        """The rows of a generation, the last without a number, each as often as it was stored."""
        there = self.generations(table)
        n = generation if generation is not None else (there or [None])[-1]
        if n not in there:
            raise LookupError(f"{table} has no generation {n}")
        rows = self._objects(table).join(self.spark.read.parquet(f"{self.root}/{table}/lists/{n}"), "digest")
        return rows.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("digest", "copies")

    def size(self, table: str) -> int:
        """Bytes of a table's objects and lists."""
        system, p = _system(self.spark, f"{self.root}/{table}")
        return system.getContentSummary(p).getLength() if system.exists(p) else 0

    def compact(self, table: str, keep: int = 2, partitions: int | None = None) -> tuple[int, int]:
        """Write the content of the last ``keep`` generations of one table together and delete the rest of it; bytes before and
        after.  Other tables aren't touched."""
        before, lists, parts = self.size(table), self.generations(table), self._numbers(table, "objects")
        kept = lists[-keep:] if keep else []
        if not kept or not parts:
            return before, before
        live = self.spark.read.parquet(*[f"{self.root}/{table}/lists/{n}" for n in kept]).select("digest").distinct()
        whole = self._objects(table).join(live, "digest", "left_semi")
        whole = whole if partitions is None else whole.coalesce(partitions)
        whole.write.mode("overwrite").parquet(f"{self.root}/{table}/objects/_{parts[-1]}")
        # a list that can be read always finds its objects: the new ones are there before the old ones go
        system, p = _system(self.spark, f"{self.root}/{table}/objects/_{parts[-1]}")
        for n in lists[: len(lists) - len(kept)]:
            _delete(self.spark, f"{self.root}/{table}/lists/{n}")
        system.rename(p, _system(self.spark, f"{self.root}/{table}/objects/{parts[-1] + 1}")[1])
        for n in parts:
            _delete(self.spark, f"{self.root}/{table}/objects/{n}")
        return before, self.size(table)
