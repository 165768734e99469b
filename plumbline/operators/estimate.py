"""Estimate of a file's depth from its operations: what callers bear against what is done for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut, rounds
from ..sources.operations import WEIGHTS
from . import incremental as inc
from . import shape


def call_edges(ops: DataFrame, across: tuple[str, ...] = ("rust",)) -> DataFrame:
    """(path, caller, callee_path, callee): calls that have exactly one candidate.

    A call is sought in its own file by owner and name.  If there is none and the call names another owner, it
    is sought in the other files of the languages ``across`` by owner and name; if there is none either and the
    caller has an owner, in its own file by name among operations without one.  Candidates are counted before
    they are joined."""
    calls = ops.select("path", "language", F.col("ordinal").alias("caller"), F.col("owner").alias("self"), F.explode("calls").alias("call"))
    parts = F.split("call", r"\.|::")
    base = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    calls = calls.select("path", "language", "caller", "self", F.element_at(parts, -1).alias("name"), F.when(base.isin("", "this", "self"), F.col("self")).otherwise(base).alias("owner")).distinct()
    one = lambda *keys: ops.groupBy(*keys).agg(F.min("ordinal").alias("id"), F.count("*").alias("n"))
    own = one("path", "owner", "name").select("path", "owner", "name", F.col("id").alias("_own"), F.col("n").alias("_own_n"))
    free = one("path", "owner", "name").where("owner = ''").select("path", "name", F.col("id").alias("_free"), F.col("n").alias("_free_n"))
    others = ops.where(F.col("language").isin(*across)).groupBy("language", "owner", "name").agg(F.count("*").alias("_all_n"), F.min_by("path", F.struct("path", "ordinal")).alias("_all_path"), F.min_by("ordinal", F.struct("path", "ordinal")).alias("_all"))
    # another file's only candidate: all there are, less those of the own file (which are none, as it is sought then)
    j = calls.join(own, ["path", "owner", "name"], "left").join(others, ["language", "owner", "name"], "left").join(free, ["path", "name"], "left")
    far = F.col("_own_n").isNull() & (F.col("owner") != "") & (F.col("owner") != F.col("self")) & F.col("_all_n").isNotNull()
    loose = F.col("_own_n").isNull() & ~far & (F.col("owner") != "") & (F.col("self") != "")
    callee = F.when(F.col("_own_n") == 1, F.col("_own")).when(far & (F.col("_all_n") == 1), F.col("_all")).when(loose & (F.col("_free_n") == 1), F.col("_free"))
    where = F.when(far, F.col("_all_path")).otherwise(F.col("path"))
    return j.select("path", "caller", where.alias("callee_path"), callee.alias("callee")).where("callee IS NOT NULL").distinct()


def reached(ops: DataFrame, edges: DataFrame, depth: int = 4, most: int = 64) -> DataFrame:
    """(path, root, at, ordinal, cut): operations (of the file ``at``) that an exposed one reaches in at most ``depth`` calls
    and over at most ``most`` calls in all, nearer ones first; ``cut`` marks those whose calls were left because
    they are on the way already, lie deeper or are too many."""
    op = F.struct("path", "ordinal")
    now = ops.where("exposed").select("path", F.col("ordinal").alias("root"), op.alias("op"), F.array(op).alias("way"), F.lit(0).alias("used"))
    out = now.select("path", "root", "op", F.lit(False).alias("cut"))
    step = edges.select(F.struct("path", F.col("caller").alias("ordinal")).alias("op"), F.struct(F.col("callee_path").alias("path"), F.col("callee").alias("ordinal")).alias("to"))
    of = Window.partitionBy("path", "root")
    for level in range(depth + 1):
        nxt = now.join(step, "op").withColumn("nth", F.col("used") + F.row_number().over(of.orderBy("op", "to", "way")))
        stop = F.array_contains("way", F.col("to")) | F.lit(level == depth) | (F.col("nth") > most)
        nxt = cut(nxt.withColumns({"stop": stop, "used": F.max("nth").over(of)}))
        out = out.union(nxt.select("path", "root", F.when(F.col("stop"), F.col("op")).otherwise(F.col("to")), "stop"))
        now = nxt.where("NOT stop").select("path", "root", F.col("to").alias("op"), F.array_append("way", F.col("to")).alias("way"), "used")
    return out.groupBy("path", "root", "op").agg(F.bool_or("cut").alias("cut")).select("path", "root", F.col("op.path").alias("at"), "op.ordinal", "cut")


@rounds
def estimate(ops: DataFrame, depth: int = 4, most: int = 64) -> DataFrame:
    """(path, burden, hidden, uncertain, ratio, penalty) of files with exposed operations.

    Each of these costs its callers 1, and a quarter for each parameter.  Evidence of hidden work counts
    once for each kind and operation, wherever it is reached from; a root with calls that were cut is
    uncertain, as is one of a file that was cut or isn't valid.
    """
    weights = F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p])
    cost = 1 + 0.25 * F.col("params")
    roots = ops.where("exposed").select("path", F.col("ordinal").alias("root"), cost.alias("cost"), (~F.col("valid") | F.col("limited")).alias("doubt"))
    seen = cut(reached(ops, cut(call_edges(ops)), depth, most))
    unsure = seen.groupBy("path", "root").agg(F.bool_or("cut").alias("cut"))
    burden = roots.join(unsure, ["path", "root"]).groupBy("path").agg(
        F.sum("cost").alias("burden"), F.sum(F.when(F.col("cut") | F.col("doubt"), F.col("cost")).otherwise(0.0)).alias("uncertain"))
    kinds = seen.select("path", "at", "ordinal").distinct().join(ops.select(F.col("path").alias("at"), "ordinal", F.explode("evidence").alias("kind")), ["at", "ordinal"])
    hidden = kinds.groupBy("path").agg(F.sum(weights[F.col("kind")]).alias("hidden"))
    j = burden.join(hidden, "path", "left").withColumn("hidden", F.coalesce("hidden", F.lit(0.0)))
    return j.select("path", "burden", "hidden", "uncertain", shape.responsibility_ratio(F.col("burden"), F.col("hidden")).alias("ratio"), shape.plain(F.col("burden"), F.col("hidden")).alias("penalty"))
