"""The change stream: coalescing of events and quiet periods.

Both work on batch and streaming frames.  On a stream, state is let go behind the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import ancestors


def coalesce(changes: DataFrame, window: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(path, window, op, n): the operations on each path in a window, as one set of bits."""
    w = changes.withWatermark("ts", late) if changes.isStreaming else changes
    return w.groupBy("path", F.window("ts", window)).agg(F.bit_or("op").alias("op"), F.count("*").alias("n"))


def bursts(changes: DataFrame, quiet: str = "80 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(unit, began, ended, paths): the changes of a unit that follow each other within the quiet
    period; each change starts the wait anew."""
    w = changes.withWatermark("ts", late) if changes.isStreaming else changes
    s = w.groupBy("unit", F.session_window("ts", quiet)).agg(F.collect_set("path").alias("paths"))
    return s.select("unit", F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), F.array_sort("paths").alias("paths"))


SCHEMA = "path string, op int, ts timestamp, all boolean"


def source(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """The stream of changes that are logged as JSON files in a folder.  A row with ``all`` says that changes were lost."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).json(folder)


def losses(changes: DataFrame) -> DataFrame:
    """(losses, last): how often changes were lost, so that all has to be looked at again, and when last."""
    return changes.where("all").agg(F.count("*").alias("losses"), F.max("ts").alias("last"))


def classify(changes: DataFrame, scopes: DataFrame) -> DataFrame:
    """``changes`` with the ``kind`` of the innermost of ``scopes(scope, recursive, kind)`` that holds their path: a file itself, a
    directory for what is right in it, or a recursive one for all below it.  Changes outside of all scopes go."""
    near = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    s = scopes.select("scope", "recursive", "kind")
    holds = F.when(F.col("scope") == F.col("path"), True).when(F.col("recursive"), F.lit(True)).otherwise(F.col("scope") == near)
    rows = changes.withColumn("_id", F.monotonically_increasing_id()) if not changes.isStreaming else changes.withColumn("_id", F.expr("uuid()"))
    up = rows.withColumn("scope", F.explode(ancestors(F.col("path"))))
    # scopes are settings: a few rows
    j = up.join(s, "scope").where(holds)
    best = j.groupBy("_id", *[F.col(f"`{c}`") for c in changes.columns]).agg(F.max_by("kind", F.char_length("scope")).alias("kind"))
    return best.drop("_id")


def start(changes: DataFrame, handle, checkpoint: str, every: str = "2 seconds") -> StreamingQuery:
    """Run ``handle(batch, number)`` on what came since the last batch, one batch at a time: changes that come meanwhile wait
    and are taken together.  A batch that failed is given again after a restart from ``checkpoint``."""
    return changes.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
