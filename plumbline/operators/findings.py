"""Findings and facts of sources as rows: type safety, owners of methods, files of a module, caller surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import incremental as inc

# The component that each kind of type-safety finding counts for.
KINDS = {
    "any_keyword": "explicit_any",
    "type_assertion": "unsafe_type_assertion", "non_null_assertion": "unsafe_type_assertion",
    "any_declaration": "unsafe_type_propagation", "any_assignment": "unsafe_type_propagation", "any_argument": "unsafe_type_propagation",
    "any_call": "unsafe_type_use", "any_member": "unsafe_type_use",
    "any_return": "unsafe_type_boundary", "public_return": "unsafe_type_boundary", "public_parameter": "unsafe_type_boundary", "public_property": "unsafe_type_boundary",
    "non_boolean_condition": "ambiguous_boolean_expression",
    "missing_cases": "non_exhaustive_union",
}


def dedupe(candidates: DataFrame) -> DataFrame:
    """Of ``candidates(component, path, start, end, symbol, kind, precedence)`` at one place the one of the lowest
    precedence, then kind; an aggregate, so copies go before the shuffle."""
    best = candidates.groupBy("component", "path", "start", "end", "symbol").agg(F.min(F.struct("precedence", "kind")).alias("b"))
    return best.select("component", "path", "start", "end", "symbol", "b.kind", "b.precedence")


def type_safety(facts: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """(component, path, start, end, symbol, kind, precedence, value): one row of value 1 for each finding among
    ``facts(path, start, end, symbol, kind, precedence)``; facts of other kinds aren't findings, and those
    of components that aren't ``requested`` (all, if None) are left out."""
    component = F.try_element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("kind"))
    c = facts.withColumn("component", component).where("component IS NOT NULL")
    if requested is not None:
        c = c.where(F.col("component").isin(requested))
    return dedupe(c.withColumn("precedence", F.coalesce("precedence", F.lit(100)))).withColumn("value", F.lit(1.0))


def missing_cases(expected: Column, present: Column, known: Column, default: Column) -> Column:
    """Cases of a union, sorted, that a switch lacks; null unless the union has several parts, all are known, there
    is no default and some are missing."""
    gone = F.array_sort(F.array_except(expected, present))
    return F.when((F.size(F.array_distinct(expected)) > 1) & known & ~default & (F.size(gone) > 0), gone)


def module_files(*lists: DataFrame) -> DataFrame:
    """(path): the files of a module that any of ``lists(path)`` names, each once."""
    out = lists[0].select("path")
    for d in lists[1:]:
        out = out.unionByName(d.select("path"))
    return out.where("path IS NOT NULL").distinct()


def returns_value(nodes: DataFrame) -> DataFrame:
    """(path, fn, returns): whether a routine has any return of an expression, from
    ``nodes(path, fn, kind, has_expression)``."""
    returns = (F.col("kind") == "return") & F.coalesce("has_expression", F.lit(False))
    return nodes.groupBy("path", "fn").agg(F.bool_or(returns).alias("returns"))


def type_owners(methods: DataFrame, types: DataFrame) -> DataFrame:
    """``methods(path, language, routine, start, ...)`` with ``owner``: the innermost of ``types(path, type, lo, hi)``
    around its start, unless the ranges of its file cross or repeat; for Go and Rust, where methods may stand
    outside, else the one type of the file that the receiver before the last point names."""
    m = methods.withColumn("_id", F.monotonically_increasing_id())
    inside = inc.enclosing(m.select("path", "_id", "start"), types.select("path", "type", "lo", "hi"), "path", "start", "lo", "hi")
    m = m.join(inside.select("_id", F.col("type").alias("_inside")), "_id", "left")
    named = types.groupBy("path", F.col("type").alias("_receiver")).agg(F.count("*").alias("_n"))
    receiver = F.when(F.col("language").isin("go", "rust") & F.col("routine").contains("."), F.regexp_extract("routine", r"^(.*)\.[^.]*$", 1))
    m = m.withColumn("_receiver", receiver).join(named, ["path", "_receiver"], "left")
    owner = F.coalesce("_inside", F.when(F.col("_n") == 1, F.col("_receiver")))
    return m.select(*methods.columns, owner.alias("owner"))


# What each part of a caller's surface weighs.
SURFACE = {"operation": 1.0, "accessor": 0.25, "input": 0.25, "alias": 0.5, "field": 2.0, "sequence": 2.0}


def caller_surface(operations: DataFrame, obligations: DataFrame) -> DataFrame:
    """(path, operations, inputs, representation): what callers of a file bear.

    ``operations(path, owner, id, constructor, accessor, inputs, outputs)``: an operation weighs as such or, where it
    only hands something on, as an accessor; each required input and each buffer that callers hand in to be
    filled adds to it.  The constructors of an owner are one choice, that of the most inputs.
    ``obligations(path, owner, kind, name)``: mutable fields that callers must keep in step (``field``), elements
    shared by reference (``alias``), each once; and orders of calls to keep (``sequence``), once an owner.
    """
    w = SURFACE
    o = operations.dropDuplicates(["path", "id"])
    calls = o.where(~F.col("constructor"))
    per = calls.groupBy("path").agg(
        F.sum(F.when(F.col("accessor"), w["accessor"]).otherwise(w["operation"])).alias("operations"),
        F.sum(w["input"] * F.col("inputs")).alias("called"), F.sum(w["alias"] * F.col("outputs")).alias("buffers"),
    )
    made = o.where("constructor").groupBy("path", "owner").agg(F.max("inputs").alias("n")).groupBy("path").agg(F.sum(w["input"] * F.col("n")).alias("made"))
    once = obligations.where(F.col("kind").isin("field", "alias")).groupBy("path", "owner", "name").agg(F.min(F.when(F.col("kind") == "alias", w["alias"]).otherwise(w["field"])).alias("units"))
    order = obligations.where("kind = 'sequence'").select("path", "owner").distinct().select("path", F.lit(w["sequence"]).alias("units"))
    shown = once.select("path", "units").unionByName(order).groupBy("path").agg(F.sum("units").alias("shown"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    j = per.join(made, "path", "full").join(shown, "path", "full")
    return j.select("path", zero("operations").alias("operations"), (zero("called") + zero("made")).alias("inputs"), (zero("buffers") + zero("shown")).alias("representation"))
