"""Interface shape and the scores taken from it: roles, shallowness, graded and ratio penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The depth expected of each role, and the confidence in it.
PRIORS = {"protocol": 0.72, "command": 1.12, "query": 1.05, "data": 0.85}
CONFIDENCE = {"data": 1.0, "protocol": 1.0, "command": 0.9, "query": 0.85, "general": 0.6, "unknown": 0.0}
# The graded surface; a single operation with one input is free.
FREE_SURFACE, REFERENCE, RESPONSIBILITY = 1.25, 1.0, 2.0


def half_away(x: Column) -> Column:
    """To the nearest whole, halves away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("double")


def role(operations: Column, interfaces: Column, public_fields: Column, results: Column, mutations: Column) -> Column:
    """Role of an interface by counts: operations, public interface types, public fields, operations
    that give a result, and those of them that change something one can see."""
    few = mutations <= F.greatest(F.lit(1), F.floor(operations / 3))
    return (
        F.when((operations == 0) & (public_fields > 0), "data")
        .when(operations == 0, "unknown")
        .when(interfaces > 0, "protocol")
        .when(results == 0, "command")
        .when((results * 2 >= operations) & few, "query")
        .otherwise("general")
    )


def depth_reference(name: Column, operations: Column, types: Column) -> Column:
    look = lambda table, other: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), name), F.lit(other))
    return 1 + (look(PRIORS, 1.0) - 1) * look(CONFIDENCE, 0.0) * F.least(F.lit(1.0), (operations + types) / 4)


def shallowness(functionality: Column, cost: Column, exposed: Column, reference: Column) -> Column:
    """0 to 100: four parts for too little function for the cost, one for exposed representation; null
    where there is no interface."""
    shallow = F.greatest(F.lit(0.0), 1 - F.try_divide(functionality, cost) / reference)
    leak = F.least(F.lit(1.0), F.try_divide(exposed, cost))
    return F.when(cost > 0, half_away(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 80 * shallow + 20 * leak))))


def module_shallowness(operations: DataFrame, types: DataFrame, exposures: DataFrame) -> DataFrame:
    """(path, role, penalty) of modules.

    ``operations(path, parameters, results, emits, mutates, type_cost, exposed)``: counts of an operation's
    parameters and results, complexity (at least 1 for each) and exposed members of their types.
    ``types(path, name, kind, public_fields, mutable_fields)``; ``exposures(path)``: a row for each
    exposed representation, which stand for the members if there are any.
    """
    gives = (F.col("results") > 0) | F.col("emits")
    n = lambda c: F.sum(c.cast("long"))
    o = operations.groupBy("path").agg(
        F.count("*").alias("ops"),
        F.sum(F.greatest(F.lit(1), "parameters") + F.greatest("results", F.col("emits").cast("int"))).alias("f"),
        F.sum("type_cost").alias("cost"), F.sum("exposed").alias("shown"), n(gives).alias("gives"), n(gives & F.col("mutates")).alias("mutates"),
    )
    public = F.trim("name").rlike("^[A-Z]")
    t = types.groupBy("path").agg(
        F.count("*").alias("all_types"), n(public).alias("types"), n(public & (F.col("kind") == "interface")).alias("interfaces"),
        F.sum(F.when(public, F.col("public_fields")).otherwise(0)).alias("fields"), F.sum(F.when(public, F.col("mutable_fields")).otherwise(0)).alias("mutable"),
    )
    e = exposures.groupBy("path").agg(F.count("*").alias("exposures"))
    j = o.join(t, "path", "full").join(e, "path", "left").na.fill(0)
    kind = role(F.col("ops"), F.col("interfaces"), F.col("fields"), F.col("gives"), F.col("mutates"))
    exposed = F.when(F.col("exposures") > 0, F.col("exposures")).otherwise(F.col("shown") + F.col("mutable"))
    j = j.withColumn("role", kind).withColumn("reference", depth_reference(F.col("role"), F.col("ops"), F.col("all_types")))
    cost = F.col("ops") + F.col("cost") + F.col("types") + F.col("fields")
    return j.select("path", "role", shallowness(F.col("f"), cost, exposed, F.col("reference")).alias("penalty"))


def graded(supported: Column, surface: Column, representation: Column, hidden: Column, reference: float = REFERENCE, weight: float = RESPONSIBILITY) -> Column:
    """Penalty of a graded surface: its supported burden against what is left over and hidden."""
    left = F.greatest(F.lit(0.0), surface - FREE_SURFACE) + representation
    return F.when(left > 0, half_away(100 * supported / (reference + left + weight * hidden))).otherwise(0.0)


def plain(burden: Column, hidden: Column) -> Column:
    """Penalty without a graded surface."""
    left = F.greatest(F.lit(0.0), burden - FREE_SURFACE)
    return half_away(100 * left / (REFERENCE + left + RESPONSIBILITY * hidden))


def responsibility_ratio(burden: Column, hidden: Column) -> Column:
    whole = burden + RESPONSIBILITY * F.greatest(F.lit(0.0), hidden)
    return F.when(burden > 0, half_away(100 * F.try_divide(burden, whole))).otherwise(0.0)


def finding_penalty(findings: DataFrame, burdens: DataFrame) -> DataFrame:
    """(path, penalty): the share of ``burdens(path, burden)`` that distinct adverse
    ``findings(path, kind, operation, parameter, adverse)`` make needless."""
    once = findings.where("adverse > 0").groupBy("path", "kind", "operation", "parameter").agg(F.max("adverse").alias("a")).groupBy("path").agg(F.sum("a").alias("a"))
    share = F.try_divide(F.least("burden", F.coalesce("a", F.lit(0.0))), F.col("burden"))
    return burdens.join(once, "path", "left").select("path", F.when(F.col("burden") > 0, half_away(100 * share)).otherwise(0.0).alias("penalty"))
