"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _with_least(e: DataFrame, total: int, made: list[str]) -> DataFrame:
    """``e(u, v)``, of at most ``total`` rows, with ``m``: the least of ``u`` and all nodes beside it."""
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    if total > common.HOT_ROWS:
        least = common.materialize(least, "least", made)
    return common.join_by_hot_key(e, least, "u", total=total).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``; ``root`` is the smallest node of its
    component.  Self-edges and repeated edges are allowed.

    Alternates two steps until the edges no longer change, which takes about the logarithm of
    the longest path: *large star* ties the larger neighbours of each node to its smallest
    neighbour, *small star* its smaller ones.  Both are a minimum by node (summed in each task
    before the shuffle) joined back to the edges; the few nodes with more than a thousandth of all
    links (and 5,000) are joined by broadcast, so that none is gathered in one place.  Each round is written to
    the shared folder.  Nothing but counts and a checksum reaches the driver.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["a"]
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = common.scratch_path(spark, "edges")
    e.write.parquet(path)
    schema, before = f"u {kind}, v {kind}", None
    while True:
        e = spark.read.schema(schema).parquet(path)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        made = [path]
        with common.sized_shuffles(spark, 2 * now[0]):
            # large star
            both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            e = _with_least(both, 2 * now[0], made).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
            made.append(common.scratch_path(spark, "step"))
            e.write.parquet(made[-1])
            # small star
            e = _with_least(spark.read.schema(schema).parquet(made[-1]), now[0], made)
            e = e.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()
            path = common.scratch_path(spark, "edges")
            e.write.parquet(path)
        for old in made:
            common.drop_path(spark, old)
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
