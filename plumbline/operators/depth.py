"""Module depth: burden, hidden obligations, and the score from both."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import state_rank

# Weights of obligation categories, and of the parts of the burden.
CATEGORY_WEIGHTS = {"V": 1, "R": 2, "C": 2, "X": 2, "Y": 2, "U": 0}
BURDEN_WEIGHTS = {"O": 8, "T": 4, "A": 2, "E": 1, "P": 8, "S": 8, "L": 16}


def burden(parts: Column) -> Column:
    """Eighths of burden of a struct with the parts O, T, A, E, P, S and L; null if a part is null or negative, or the sum beyond 64 bits.

    Halves of 32 bits are added up apart: no sum of theirs can overflow, so no row has to fail and be caught."""
    part = lambda p: F.when(parts[p] >= 0, parts[p]).cast("long")
    low, half = F.lit((1 << 32) - 1), F.lit(1 << 32)
    high = reduce(lambda a, b: a + b, [F.shiftright(part(p), 32) * F.lit(w).cast("long") for p, w in BURDEN_WEIGHTS.items()])
    rest = reduce(lambda a, b: a + b, [part(p).bitwiseAND(low) * F.lit(w).cast("long") for p, w in BURDEN_WEIGHTS.items()])
    high = high + F.shiftright(rest, 32)
    return F.when(high < F.lit(1 << 31), high * half + rest.bitwiseAND(low))


def hidden(alternatives: Column, categories: Column) -> Column:
    """The least weight of a set of obligations; ``alternatives`` is an array of arrays of ids,
    ``categories`` a map from id to category."""
    weights = F.create_map(*[F.lit(x) for pair in CATEGORY_WEIGHTS.items() for x in pair])
    one = lambda ids: F.aggregate(F.array_distinct(ids), F.lit(0), lambda s, i: s + F.coalesce(F.try_element_at(weights, F.try_element_at(categories, i)), F.lit(0)))
    return F.coalesce(F.array_min(F.transform(alternatives, one)), F.lit(0))


def shallow(b8: Column, h: Column) -> Column:
    """From 0 to 100, to the nearest whole; null without burden."""
    d = b8 + 16 * h
    return F.when(b8 > 0, F.least(F.lit(100), F.floor((200 * b8 + d) / (2 * d)).cast("long")))


def cross(families: Column, most: int = 32) -> Column:
    """All unions of one alternative of each family, or null beyond ``most``."""
    start = F.array(F.array().cast("array<string>"))
    step = lambda acc, family: F.when(F.size(acc) > most, acc).otherwise(F.array_distinct(F.flatten(F.transform(acc, lambda a: F.transform(family, lambda b: F.array_sort(F.array_union(a, b)))))))
    out = F.aggregate(families, start, step)
    return F.when(F.size(out) <= most, out)


def cheapest_route(routes: DataFrame) -> DataFrame:
    """Of ``routes(family, route_id, a, e, p, s)`` the cheapest of each family, ties by id."""
    cost = 2 * F.col("a") + F.col("e") + 8 * F.col("p") + 8 * F.col("s")
    return routes.groupBy("family").agg(F.min(F.struct(cost.alias("cost"), "route_id")).alias("b")).select("family", "b.route_id", "b.cost")


def faults(boundaries: DataFrame) -> DataFrame:
    """(boundary, fault): what is wrong with ``boundaries(boundary, b, families, alternatives, categories)``, a row
    for each fault; those without any have none."""
    ids = F.array_distinct(F.flatten("alternatives"))
    checks = {
        "identity": F.coalesce(F.trim("boundary"), F.lit("")) == "",
        "negative_burden": F.array_min(F.array(*[F.col("b")[p] for p in BURDEN_WEIGHTS])) < 0,
        "repeated_family": F.size(F.array_distinct("families")) < F.size("families"),
        "no_alternative": (F.size("families") > 0) & (F.size("alternatives") == 0),
        "unknown_obligation": F.size(F.array_except(ids, F.map_keys("categories"))) > 0,
        "unknown_category": F.size(F.array_except(F.array_distinct(F.map_values("categories")), F.array(*[F.lit(c) for c in CATEGORY_WEIGHTS]))) > 0,
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks.items()]))
    return boundaries.select("boundary", F.explode(found).alias("fault"))


def publish(b8: Column, h: Column, role: Column, essential_unknown: Column, complete: Column, bounded: Column) -> Column:
    """struct(state, value) of a boundary.

    Passive data is 0; passive creation and supporting contracts aren't applicable; where an essential
    fact is unknown or the alternatives aren't complete there is only the ``bounded`` estimate, or, without
    one, no value.
    """
    score = shallow(b8, h)
    lacking = essential_unknown | ~complete
    state = (
        F.when(role == "passive_data", "measured")
        .when(role.isin("passive_creation", "supporting_contract"), "not_applicable")
        .when(lacking & bounded.isNotNull(), "estimated")
        .when(essential_unknown, "unavailable")
        .when(~complete, "partial")
        .when(score.isNull(), "not_applicable")
        .otherwise("measured")
    )
    value = F.when(role == "passive_data", F.lit(0).cast("long")).when(state == "estimated", bounded.cast("long")).when(state == "measured", score)
    return F.struct(state.alias("state"), value.alias("value"))


def per_file(boundaries: DataFrame, declarations: DataFrame | None = None) -> DataFrame:
    """(path, state, value) of the files of ``boundaries(boundary, files, state, value)``.

    The value is the largest of those boundaries that apply and have one; what is estimated counts, but makes
    the file partial; the worst state counts.  A file whose boundaries are measured but without any value
    is unavailable.  A file of ``declarations(path)`` holds nothing but a contract and is 0.
    """
    applies = ~F.col("state").isin("unavailable", "not_applicable")
    state = F.when(F.col("state") == "estimated", "partial").otherwise(F.col("state"))
    rows = boundaries.select(F.explode("files").alias("path"), state.alias("state"), F.when(applies, F.col("value")).alias("value"))
    g = rows.groupBy("path").agg(F.max_by("state", state_rank(F.col("state"))).alias("state"), F.max("value").alias("value"))
    state = F.when((F.col("state") == "measured") & F.col("value").isNull(), "unavailable").otherwise(F.col("state"))
    out = g.select("path", state.alias("state"), "value")
    if declarations is None:
        return out
    zero = declarations.select("path").distinct().select("path", F.lit("measured").alias("state"), F.lit(0).cast(out.schema["value"].dataType).alias("value"))
    return out.join(zero.select("path"), "path", "left_anti").unionByName(zero)


def inventory_fingerprint(files: Column, operations: Column, concepts: Column) -> Column:
    """SHA-256 of an inventory as JSON with sorted, distinct lists."""
    tidy = lambda c: F.array_sort(F.array_distinct(c))
    return F.sha2(F.to_json(F.struct(tidy(files).alias("files"), tidy(operations).alias("operations"), tidy(concepts).alias("concepts"))).cast("binary"), 256)


def reconcile(precise: DataFrame, estimated: DataFrame) -> DataFrame:
    """(path, value, origin, complete): the precise value of a file, else its estimate, which leaves the file
    incomplete."""
    p, e = precise.select("path", F.col("value").alias("p")), estimated.select("path", F.col("value").alias("e"))
    origin = F.when(F.col("p").isNotNull(), "precise").when(F.col("e").isNotNull(), "estimated")
    return p.join(e, "path", "full").select("path", F.coalesce("p", "e").alias("value"), origin.alias("origin"), F.col("p").isNotNull().alias("complete"))


def projected(surfaces: DataFrame) -> DataFrame:
    """(path, value): a type's whole surface falls on every file that implements a part of it, and a file takes
    its largest; from ``surfaces(owner, path, operation, value)``, with repeated operations counted once."""
    once = surfaces.groupBy("owner", "operation").agg(F.max("value").alias("v")).groupBy("owner").agg(F.sum("v").alias("value"))
    return surfaces.select("owner", "path").distinct().join(once, "owner").groupBy("path").agg(F.max("value").alias("value"))
