"""A histogram that follows a stream of scores: each batch adds what moved, and counts once however often it is given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import bucket
from .ranks import histogram_moves

_BINS = "path string, bin int"
_MOVES = "bin int, files long"


def _folders(spark: SparkSession, folder: str, kind: str) -> list[tuple[int, str]]:
    """(number, path) of the tables of a kind, in order; half-written ones have no mark of success."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for s in system.listStatus(root) if system.exists(root) else []:
        name, _, number = s.getPath().getName().rpartition("-")
        if name == kind and system.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found.append((int(number), s.getPath().toString()))
    return sorted(found)


def _read(spark: SparkSession, folder: str, kind: str, before: int) -> DataFrame:
    """All rows of a kind with the ``number`` of their batch, of those before ``before``: the last whole table and what came since."""
    schema = _BINS if kind == "bins" else _MOVES
    base = [x for x in _folders(spark, folder, f"all-{kind}") if x[0] < before][-1:]
    since = [x for x in _folders(spark, folder, kind) if x[0] < before and (not base or x[0] > base[0][0])]
    out = spark.createDataFrame([], schema).withColumn("number", F.lit(0).cast("long"))
    for number, path in base + since:
        out = out.unionByName(spark.read.schema(schema).parquet(path).withColumn("number", F.lit(number).cast("long")))
    return out


def _last(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.max_by("bin", "number").alias("bin"))


def add_batch(batch: DataFrame, number: int, folder: str) -> None:
    """Take in a batch ``(path, at, score)``: of each path the last score counts; a null one takes the path out.

    What a path moved from is what the batches before this number say, and a batch's tables are written over when it is given
    again, so the result is the same.  A batch that a whole table already holds changes nothing.
    """
    spark = batch.sparkSession
    if any(number <= n for n, _ in _folders(spark, folder, "all-moves")):
        return
    new = batch.groupBy("path").agg(F.max_by(F.struct("score"), F.struct("at", "score")).alias("s")).select("path", F.when(F.col("s.score").isNotNull(), bucket(F.col("s.score"))).alias("bin"))
    new.write.mode("overwrite").parquet(f"{folder}/bins-{number}")
    new = spark.read.schema(_BINS).parquet(f"{folder}/bins-{number}")
    old = _last(_read(spark, folder, "bins", number).join(new.select("path"), "path", "left_semi"))
    histogram_moves(old.where("bin IS NOT NULL"), new.where("bin IS NOT NULL")).select(F.col("bin"), "files").coalesce(1).write.mode("overwrite").parquet(f"{folder}/moves-{number}")


def follow(scores: DataFrame, folder: str, checkpoint: str, **trigger):
    """Start :func:`add_batch` on a *streaming* ``scores(path, at, score)``."""
    return scores.writeStream.foreachBatch(lambda b, n: add_batch(b, n, folder)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def histogram(spark: SparkSession, folder: str) -> DataFrame:
    """(bin, files) of the paths whose score is known; bins without files are left out."""
    return _read(spark, folder, "moves", 1 << 62).groupBy("bin").agg(F.sum("files").alias("files")).where("files <> 0")


def fold(spark: SparkSession, folder: str) -> None:
    """Write whole tables of all batches so far, so that later reads open two tables and what came since.  Paths are written before
    moves, and only the latter make the fold count."""
    done = _folders(spark, folder, "moves")
    if not done:
        return
    n = done[-1][0]
    _last(_read(spark, folder, "bins", n + 1)).write.mode("overwrite").parquet(f"{folder}/all-bins-{n}")
    _read(spark, folder, "moves", n + 1).groupBy("bin").agg(F.sum("files").alias("files")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/all-moves-{n}")
