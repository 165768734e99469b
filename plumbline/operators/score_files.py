"""Scores of files, from measurements, coverage, a catalog of components and a policy.

One plan of joins and aggregates: measurements become severities, a routine is charged for its strongest
signal alone, a type for what its routines don't carry, and components, axes and score are sums that
are rounded at each step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import severity as sev
from . import scoring as sc

# Component, axis, kind, aggregation, formula, baseline, threshold, weight, enabled, languages.
ALL, TS = ["go", "java", "rust", "typescript"], ["typescript"]
COMPONENTS = [
    ("ambiguous_boolean_expression", "typescript_type_safety", "count", "sum", "log-count", None, None, 4.0, True, TS),
    ("cognitive_complexity", "structural_core", "continuous", "sum", "continuous-log", 0.0, 15.0, 10.0, True, ALL),
    ("coupling_between_objects", "structural_language", "continuous", "max", "log-ratio", None, 20.0, 10.0, True, ALL),
    ("cyclomatic_class_complexity", "structural_language", "continuous", "max", "log-ratio", None, 80.0, 5.0, True, ALL),
    ("cyclomatic_method_complexity", "structural_core", "continuous", "sum", "continuous-log", 1.0, 10.0, 5.0, True, ALL),
    ("deeply_nested_if", "structural_core", "count", "sum", "count", None, None, 6.0, True, ALL),
    ("explicit_any", "typescript_type_safety", "count", "sum", "log-count", None, None, 3.0, True, TS),
    ("god_class", "structural_language", "compound", "sum", "god-class/pmd-v1", None, None, 1.0, True, ALL),
    ("module_shallowness", "structural_core", "continuous", "max", "log-ratio", None, 20.0, 5.0, True, ALL),
    ("non_exhaustive_union", "typescript_type_safety", "count", "sum", "log-count", None, None, 8.0, True, TS),
    ("npath_complexity", "structural_core", "continuous", "sum", "continuous-log", 1.0, 200.0, 8.0, True, ALL),
    ("type_complexity", "rust_design", "count", "sum", "log-count", None, None, 7.0, False, []),
    ("unsafe_type_assertion", "typescript_type_safety", "count", "sum", "log-count", None, None, 5.0, True, TS),
    ("unsafe_type_boundary", "typescript_type_safety", "count", "sum", "log-count", None, None, 10.0, True, TS),
    ("unsafe_type_propagation", "typescript_type_safety", "count", "sum", "log-count", None, None, 4.0, True, TS),
    ("unsafe_type_use", "typescript_type_safety", "count", "sum", "log-count", None, None, 4.0, True, TS),
]
CATALOG = "component string, axis string, kind string, aggregation string, formula string, baseline double, threshold double, weight double, enabled boolean, languages array<string>"
# The signals of which a routine is charged for the strongest, and types against methods.
CONTROL_FLOW = ["cognitive_complexity", "cyclomatic_method_complexity", "deeply_nested_if", "npath_complexity"]
TYPES, METHODS, NESTED = "cyclomatic_class_complexity", "cyclomatic_method_complexity", "deeply_nested_if"


def catalog(spark: SparkSession, typed: bool = False) -> DataFrame:
    """The table of components; those of type safety are off unless sources were analysed with types."""
    rows = [(*r[:8], r[8] and (typed or r[1] != "typescript_type_safety"), r[9]) for r in COMPONENTS]
    return spark.createDataFrame(rows, CATALOG)


def with_policy(components: DataFrame, policy: DataFrame | None) -> DataFrame:
    """``components`` with ``weight_now`` and ``enabled_now`` of a ``policy(component, weight, enabled)``: what it
    leaves null or out is as in the catalog, and an explicit zero stays zero."""
    if policy is None:
        return components.withColumns({"weight_now": F.col("weight"), "enabled_now": F.col("enabled")})
    p = policy.select("component", F.col("weight").alias("_w"), F.col("enabled").alias("_e"))
    j = components.join(F.broadcast(p), "component", "left")  # at most a row for each component
    return j.withColumns({"weight_now": F.coalesce("_w", "weight"), "enabled_now": F.coalesce("_e", "enabled")}).drop("_w", "_e")


@dataclass(frozen=True)
class Scores:
    """``subjects``, ``components``, ``axes`` and ``files`` of a scored set of files; ``parts`` has the components of a file in one row."""

    subjects: DataFrame
    components: DataFrame
    axes: DataFrame
    files: DataFrame
    parts: DataFrame


def _step_sum(values: Column) -> Column:
    """Sum of an array in its order, rounded at each step."""
    return F.aggregate(values, F.lit(0.0), lambda s, v: sev.exact(s + v))


def measured(observations: DataFrame, components: DataFrame) -> DataFrame:
    """(path, component, subject, routine, owner, value, wmc, atfd, tcc): the subjects of ``score``'s observations.

    A count component has one subject, the number of its rows; nested ifs are counted by routine.  Components are
    those of the catalog, whose rows are few.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    counts = [r[0] for r in components.where("kind = 'count'").select("component").distinct().collect()]
    unassociated = F.concat(F.lit("unassociated:"), blank("subject"))
    key = F.when(F.col("component") != NESTED, F.lit("deduplicated_count")).when(blank("routine") != "", F.col("routine")).otherwise(unassociated)
    none = F.lit(None).cast("double")
    counted = observations.where(F.col("component").isin(counts)).groupBy("path", "component", key.alias("subject")).agg(F.count("*").cast("double").alias("value"))
    counted = counted.select("path", "component", "subject", F.lit("").alias("routine"), F.lit("").alias("owner"), "value", none.alias("wmc"), none.alias("atfd"), none.alias("tcc"))
    rest = observations.where(~F.col("component").isin(counts))
    rest = rest.select("path", "component", blank("subject").alias("subject"), blank("routine").alias("routine"), blank("owner").alias("owner"), *[F.col(c).cast("double").alias(c) for c in ("value", "wmc", "atfd", "tcc")])
    return counted.unionByName(rest)


def _states(files: DataFrame, coverage: DataFrame, cat: DataFrame) -> DataFrame:
    """(path, language, wanted, complete): the components of each file, in their order, as structs with axis and state, and the names of
    the complete ones.  Lists are no longer than the catalog."""
    on = cat.where("enabled")
    known = coverage.join(F.broadcast(on.select("component")), "component").groupBy("path").agg(F.collect_set(F.struct("component", "state")).alias("_known"))
    rules = on.agg(F.array_sort(F.collect_list(F.struct("component", "axis", "languages"))).alias("_rules"))
    f = files.select("path", "language").distinct().join(known, "path", "left").join(F.broadcast(rules))

    def one(r: Column) -> Column:
        # of several states any other than complete counts
        found = F.array_max(F.transform(F.filter("_known", lambda k: k["component"] == r["component"]), lambda k: k["state"]))
        return F.struct(r["component"].alias("component"), r["axis"].alias("axis"), F.coalesce(found, F.lit("not_requested")).alias("state"))

    wanted = F.transform(F.filter("_rules", lambda r: F.coalesce(F.array_contains(r["languages"], F.col("language")), F.lit(False))), one)
    f = f.select("path", "language", wanted.alias("wanted"))
    return f.withColumn("complete", F.transform(F.filter("wanted", lambda w: w["state"] == "complete"), lambda w: w["component"]))


def score(files: DataFrame, observations: DataFrame, coverage: DataFrame, components: DataFrame, policy: DataFrame | None = None, most: float | None = None) -> Scores:
    """Scores of ``files(path, language)``, a row for each path.

    ``observations(path, component, subject, routine, owner, value, wmc, atfd, tcc)`` count only where
    ``coverage(path, component, state)`` is ``complete``; a file is complete if that holds for all components
    that are enabled in the catalog and have its language.  With ``most`` a file passes if it is complete and
    its score isn't above.

    Observations and states meet by path, and what follows is windows and aggregates within a path: they are shuffled once, nothing
    is written, and no list is longer than the catalog.
    """
    cat = with_policy(components, policy)
    states = _states(files, coverage, cat)
    rules = cat.select("component", "kind", "formula", F.coalesce("baseline", F.lit(0.0)).alias("baseline"), "threshold", "weight", "weight_now", "enabled_now")
    s = measured(observations, components).join(states.select("path", "complete"), "path").where(F.array_contains("complete", F.col("component"))).drop("complete")
    s = s.join(F.broadcast(rules), "component")
    god = sev.god_class(F.col("wmc"), F.col("atfd"), F.col("tcc"))
    plain = sev.by_formula(F.col("formula"), F.col("value"), F.col("baseline"), F.col("threshold"))
    s = s.withColumn("base", F.when(F.col("kind") == "compound", god).otherwise(plain))
    now = F.when(F.col("enabled_now"), sev.exact(F.col("base") * F.col("weight_now"))).otherwise(0.0)
    # what a routine's signals are one group by
    group = F.when(F.col("routine") != "", F.col("routine")).when(F.col("subject") != "", F.col("subject")).otherwise(F.concat(F.lit("unassociated:"), "component"))
    flow = F.col("component").isin(CONTROL_FLOW)
    s = s.select("path", "component", "subject", "routine", "owner", "value", "base", sev.exact(F.col("base") * F.col("weight")).alias("observed"), now.alias("contribution"), group.alias("grp"))

    # a routine is charged for its strongest signal; ties go to the first component, then subject
    live = F.coalesce(flow & (F.col("contribution") != 0), F.lit(False))
    strongest = Window.partitionBy("path", "grp").orderBy(F.desc("_live"), F.desc("contribution"), "component", "subject")
    s = s.withColumn("_live", live).withColumns({"_nth": F.row_number().over(strongest), "_charge": F.first(F.when(F.col("_live"), F.col("contribution"))).over(strongest)})
    s = s.withColumn("charged", F.when((F.col("_nth") == 1) & F.col("_live"), F.col("contribution")))

    # types, less what the routines of their methods are charged, each once
    is_type = F.col("component") == TYPES
    owner = F.when(is_type, F.col("subject")).when((F.col("component") == METHODS) & (F.col("owner") != ""), F.col("owner"))
    s = s.withColumns({"_owner": owner, "_type": is_type})
    methods = Window.partitionBy("path", "_owner").orderBy("_type", "grp")
    first = ~F.col("_type") & F.col("_owner").isNotNull() & ~F.col("grp").eqNullSafe(F.lag("grp").over(methods))
    s = s.withColumn("_own", F.when(first, F.col("_charge")))
    owned = F.sum("_own").over(methods.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("_owned", F.when(F.col("_type"), owned))
    left = F.when(F.col("_owned").isNotNull(), sev.exact(F.greatest(F.lit(0.0), F.col("contribution") - F.col("_owned")))).otherwise(F.col("contribution"))
    s = s.withColumn("contribution", left)
    names = ["path", "component", "subject", "routine", "owner", "value", "base", "observed", "contribution", "grp"]

    total = lambda c: (F.max(c).alias(f"_max_{c}"), F.sum(c).alias(f"_sum_{c}"))
    sums = s.groupBy("path", "component").agg(*total("observed"), *total("contribution"), F.sum("charged").alias("charged"), F.count("*").alias("subjects"), F.max("value").alias("largest"), F.sum("value").alias("total"))
    sums = sums.join(F.broadcast(cat.select("component", (F.col("aggregation") == "max").alias("_top"))), "component")
    of = lambda c: F.coalesce(F.when(F.col("_top"), F.col(f"_max_{c}")).otherwise(F.col(f"_sum_{c}")), F.lit(0.0))
    value = F.when(flow, F.coalesce("charged", F.lit(0.0))).otherwise(of("contribution"))
    sums = sums.select("path", "component", "subjects", "largest", "total", sev.exact(of("observed")).alias("observed"), sev.exact(value).alias("contribution"))
    each = sums.groupBy("path").agg(F.collect_list(F.struct("component", "subjects", "largest", "total", "observed", "contribution")).alias("_sums"))

    # sums in the order of the components that are wanted, null where there are none
    found = F.transform("wanted", lambda w: F.try_element_at(F.filter("_sums", lambda x: x["component"] == w["component"]), F.lit(1)))

    def merged(w: Column, m: Column) -> Column:
        zero = lambda c, z: F.coalesce(m[c], z).alias(c)
        return F.struct(w["component"].alias("component"), w["axis"].alias("axis"), w["state"].alias("state"), zero("subjects", F.lit(0).cast("long")), m["largest"].alias("largest"), m["total"].alias("total"), zero("observed", F.lit(0.0)), zero("contribution", F.lit(0.0)))

    by_file = states.select("path", "language", "wanted").join(each, "path", "left").select("path", "language", F.zip_with("wanted", found, merged).alias("parts"))
    c = by_file.select("path", F.inline("parts"))

    # the components of an axis in their order, and the axes in theirs
    within = lambda a, v: _step_sum(F.transform(F.filter("parts", lambda x: x["axis"] == a), lambda x: x[v]))
    axis = lambda a: F.struct(a.alias("axis"), within(a, "contribution").alias("value"), within(a, "observed").alias("observed"))
    summed = by_file.withColumn("_axes", F.transform(F.array_sort(F.array_distinct(F.transform("parts", lambda x: x["axis"]))), axis))
    plus = lambda v: sev.exact(F.aggregate(F.transform("_axes", lambda x: x[v]), F.lit(0.0), lambda a, x: a + x))
    done = lambda x: x["state"] == "complete"
    # a file of no component is complete, and its score nothing
    out = summed.select("path", "language", plus("value").alias("score"), plus("observed").alias("observed_score"), F.forall("parts", done).alias("complete"), F.exists("parts", done).alias("available"))
    out = out.withColumn("valid_zero", F.col("complete") & (F.col("score") == 0))
    out = out.withColumn("passed", sc.gate(F.col("score"), F.col("complete"), most) if most is not None else F.lit(None).cast("boolean"))
    return Scores(s.select(*names), c, summed.select("path", F.inline("_axes")), out, by_file)


def summary(files: DataFrame) -> DataFrame:
    """(files_analyzed, complete_files, failed_files, passed) of the ``files`` of a :class:`Scores`."""
    n = F.sum(F.col("complete").cast("long"))
    return files.agg(F.count("*").alias("files_analyzed"), n.alias("complete_files"), (F.count("*") - n).alias("failed_files"), F.every("passed").alias("passed"))


# What a view shows of a metric: an axis, a contribution, the largest or the sum of subjects.
METRICS = {
    "cog": ("cognitive_complexity", "largest"), "npath": ("npath_complexity", "largest"), "cyclo": ("cyclomatic_method_complexity", "largest"),
    "deep": ("module_shallowness", "total"), "god": ("god_class", "contribution"), "coupling": ("coupling_between_objects", "largest"),
    "nesting": ("deeply_nested_if", "total"), "typesafety": ("typescript_type_safety", "axis"),
}


def metrics(scores: Scores) -> DataFrame:
    """(path, metric, value, available): the metrics of a view, 0 at least; available where the component, or one
    of the axis, was measured completely."""
    names = {c: (m, how) for m, (c, how) in METRICS.items() if how != "axis"}
    axis = METRICS["typesafety"][0]
    look = lambda i, c: F.try_element_at(F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v[i])]), c)
    row = lambda metric, value, available: F.struct(metric.alias("metric"), F.greatest(F.lit(0.0), F.coalesce(value, F.lit(0.0))).alias("value"), available.alias("available"))

    def shown(x: Column) -> Column:
        how = look(1, x["component"])
        value = F.when(how == "largest", x["largest"]).when(how == "total", x["total"]).otherwise(x["contribution"])
        return row(look(0, x["component"]), value, x["state"] == "complete")

    own = F.transform(F.filter("parts", lambda x: x["component"].isin(list(names))), shown)
    of = F.filter("parts", lambda x: x["axis"] == axis)
    safe = row(F.lit("typesafety"), _step_sum(F.transform(of, lambda x: x["contribution"])), F.exists(of, lambda x: x["state"] == "complete"))
    return scores.parts.select("path", F.inline(F.concat(own, F.when(F.size(of) > 0, F.array(safe)).otherwise(F.array().cast("array<struct<metric:string,value:double,available:boolean>>")))))
