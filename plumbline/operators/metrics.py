"""Metrics of a flat table of syntax nodes, ``ast_nodes(path, fn, node_id, kind, operators,
is_default, if_depth)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cyclomatic(nodes: DataFrame) -> DataFrame:
    """(path, fn, cyclomatic): one, and one for each branch, case and jump, and for each boolean operator
    but those of a jump."""
    ops = F.coalesce("operators", F.lit(0))
    points = F.when(F.col("kind").isin("if", "loop"), 1 + ops).when((F.col("kind") == "case") & F.coalesce("is_default", F.lit(False)), ops).when(F.col("kind") == "case", 1 + ops).when(F.col("kind").isin("break", "continue", "goto", "panic"), 1).otherwise(ops)
    return nodes.groupBy("path", "fn").agg((1 + F.sum(points)).cast("long").alias("cyclomatic"))


def deeply_nested(nodes: DataFrame) -> DataFrame:
    """The ifs that are the third within each other."""
    return nodes.where("kind = 'if' AND if_depth = 3").select("path", "fn", "node_id")


def routine_name(receiver: Column, name: Column) -> Column:
    """``Receiver.name``; a constructor is ``Receiver.<init>``."""
    own = F.when(name == receiver, F.lit("<init>")).otherwise(name)
    return F.when(F.coalesce(receiver, F.lit("")) == "", name).otherwise(F.concat_ws(".", receiver, own))


def tcc(methods: DataFrame) -> DataFrame:
    """Tight class cohesion of ``methods(type, method, fields)``: the share of pairs of methods
    that use a common field; 0 below two methods."""
    use = methods.select("type", "method", F.explode("fields").alias("field")).distinct()
    pairs = use.alias("a").join(use.alias("b"), ["type", "field"]).where("a.method < b.method").select("type", F.col("a.method").alias("x"), F.col("b.method").alias("y")).distinct()
    n = methods.groupBy("type").agg(F.countDistinct("method").alias("n"))
    share = F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("c", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2))
    return n.join(pairs.groupBy("type").agg(F.count("*").alias("c")), "type", "left").select("type", share.alias("tcc"))


def wmc(types: DataFrame, methods: DataFrame) -> DataFrame:
    """(type, wmc): the complexity of the methods of a type, ``methods(type, cyclomatic)``, and one for each method that
    ``types(type, interface_methods)`` only declares."""
    own = methods.groupBy("type").agg(F.sum("cyclomatic").alias("own"))
    j = types.select("type", "interface_methods").join(own, "type", "left")
    return j.select("type", (F.coalesce("interface_methods", F.lit(0)) + F.coalesce("own", F.lit(0))).cast("double").alias("wmc"))


def coupling(uses: DataFrame, unavailable: DataFrame | None = None) -> DataFrame:
    """(type, cbo): how many distinct types, by names that aren't empty, each type of ``uses(type, foreign)`` names; types in
    ``unavailable(type)`` are left out."""
    rows = uses.select("type", "foreign")
    if unavailable is not None:
        rows = rows.join(unavailable.select("type").distinct(), "type", "left_anti")
    return rows.groupBy("type").agg(F.countDistinct(F.when(F.col("foreign").cast("string") != "", F.col("foreign"))).alias("cbo"))
