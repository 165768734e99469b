"""Graphs of units: strongly connected components, Merkle fingerprints, affected units.

Rounds of joins on ``units`` and ``edges(src, dst)`` (src depends on dst).  Each round's result is
cut off from its plan by a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, rounds
from .incremental import closure


#: Fixed value: the first line of what a component's fingerprint is taken of.
FINGERPRINT = "dependency-component-v1"


def _spread(nodes: DataFrame, edges: DataFrame, color: str) -> DataFrame:
    """(id, color): the least color that reaches each node along ``edges(src, dst)``."""
    now = nodes.select("id", F.col(color).alias("color"))
    while True:
        came = edges.join(now, edges.src == now.id).groupBy("dst").agg(F.min("color").alias("c"))
        nxt = now.join(came, now.id == came.dst, "left").select("id", F.least("color", F.coalesce("c", "color")).alias("color"), (F.col("c") < F.col("color")).alias("moved"))
        nxt = cut(nxt)
        now = nxt.select("id", "color")
        if nxt.where("moved").isEmpty():
            return now


@rounds
def components(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of ``units(id)``: the component is the least id of the units that reach each
    other.  Units that nothing in question depends on, or that depend on nothing, are peeled off first;
    the rest is coloured forward, then each colour's own unit takes those that reach it back."""
    left = cut(units.select("id").distinct())
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct().join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"))
    done = left.select("id", F.col("id").alias("component")).limit(0)
    while not left.isEmpty():
        inner = left.join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
        inner = cut(inner)
        alone = left.join(inner, "id", "left_anti")
        if alone.isEmpty():
            color = _spread(inner.withColumn("c", F.col("id")), edges, "c")
            by = lambda end: color.select(F.col("id").alias(end), F.col("color").alias(f"{end}_color"))
            same = edges.join(by("src"), "src").join(by("dst"), "dst").where("src_color = dst_color")
            back = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            roots = color.select("id", "color", F.when(F.col("id") == F.col("color"), 0).otherwise(1).alias("c"))
            found = _spread(roots, cut(back), "c").where("color = 0").select("id").join(color, "id").select("id", F.col("color").alias("component"))
        else:
            found = alone.select("id", F.col("id").alias("component"))
        found = cut(found)
        done = done.union(found)
        left = cut(left.join(found, "id", "left_anti"))
        edges = cut(edges.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"))
    return done


@rounds
def fingerprints(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component, fingerprint) of ``units(id, key)``: SHA-256 over the keys of the component's units
    and the fingerprints of the components it depends on, so that a change reaches all that depend on it.
    Each round does the components whose dependencies are done."""
    of = cut(components(units, edges))
    own = units.join(of, "id").groupBy("component").agg(F.array_sort(F.collect_list(F.concat_ws("=", F.concat(F.lit("unit:"), F.col("id").cast("string")), "key"))).alias("own"))
    end = lambda e: of.select(F.col("id").alias(e), F.col("component").alias(f"{e}_c"))
    deps = cut(edges.select("src", "dst").join(end("src"), "src").join(end("dst"), "dst").where("src_c <> dst_c").select(F.col("src_c").alias("component"), F.col("dst_c").alias("dep")).distinct())
    todo = cut(own)
    done = todo.select("component", F.lit("").alias("fingerprint")).limit(0)
    while not todo.isEmpty():
        have = deps.join(done.select(F.col("component").alias("dep"), "fingerprint"), "dep", "left")
        parts = have.groupBy("component").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("fingerprint").isNotNull(), F.concat_ws("=", F.concat(F.lit("dependency:"), F.col("dep").cast("string")), "fingerprint")))).alias("deps"))
        j = todo.join(parts, "component", "left").where("n IS NULL OR n = size(deps)")
        text = F.concat_ws("\n", F.lit(FINGERPRINT), F.array_join("own", "\n"), F.array_join(F.coalesce("deps", F.array().cast("array<string>")), "\n"))
        found = cut(j.select("component", F.sha2(text.cast("binary"), 256).alias("fingerprint")))
        done = cut(done.union(found))
        todo = cut(todo.join(found, "component", "left_anti"))
    return of.join(done, "component").select("id", "component", "fingerprint")


def affected(spark: SparkSession, changed: DataFrame, consumers: DataFrame, conservative: DataFrame, edges: DataFrame) -> DataFrame:
    """(node): units to analyse again after ``changed(path, language)``.

    They are the ``consumers(path, unit)`` of the paths and the ``conservative(language, unit)`` units
    of the languages, of the old and the new plan together, and all that depend on them by
    ``edges(src, dst)``."""
    hit = consumers.join(changed.select("path").distinct(), "path", "left_semi").select(F.col("unit").alias("node"))
    wide = conservative.join(changed.select("language").distinct(), "language", "left_semi").select(F.col("unit").alias("node"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(spark, back, hit.union(wide))


def context_sources(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(unit, path): sources of a unit's dependencies that aren't its own, from ``sources(unit, path)``."""
    theirs = edges.join(sources, edges.dst == sources.unit).select(F.col("src").alias("unit"), "path").distinct()
    return theirs.join(sources.select("unit", "path"), ["unit", "path"], "left_anti")


def changed_files(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, change): added, removed, or stamped anew, from ``(path, size, mtime)``; contents have to be
    hashed only for the last."""
    s = stored.select("path", F.struct("size", "mtime").alias("was"))
    n = seen.select("path", F.struct("size", "mtime").alias("is_"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is_").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is_")), "stamped")
    return s.join(n, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")
