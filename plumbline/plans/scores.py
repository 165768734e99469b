"""Scoring end to end: orders stand for files, their lines for routines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import score_files as sf
from .catalog import _t, query

_LANGUAGE = "CASE {0} % 4 WHEN 0 THEN 'go' WHEN 1 THEN 'java' WHEN 2 THEN 'rust' ELSE 'typescript' END"
_SQL = f"""li AS (SELECT l_orderkey AS path, l_linenumber::VARCHAR AS routine, * FROM lineitem),
cov AS (SELECT DISTINCT path, c.component, c.axis, c.agg, c.w, c.w2, path % 11 = 0 AND c.component = 'npath_complexity' AS failed FROM li, (VALUES
  ('cognitive_complexity', 'structural_core', 'sum', 10.0::DOUBLE, 10.0::DOUBLE), ('coupling_between_objects', 'structural_language', 'max', 10.0, 0.0), ('cyclomatic_class_complexity', 'structural_language', 'max', 5.0, 5.0),
  ('cyclomatic_method_complexity', 'structural_core', 'sum', 5.0, 9.0), ('deeply_nested_if', 'structural_core', 'sum', 6.0, 6.0), ('god_class', 'structural_language', 'sum', 1.0, 1.0), ('npath_complexity', 'structural_core', 'sum', 8.0, 8.0)) c(component, axis, agg, w, w2)),
obs AS (
  SELECT path, 'cognitive_complexity' AS component, routine AS subject, '' AS routine, 'T' || l_linenumber % 2 AS owner, log2(1 + 100 * l_discount / 15) AS base, 100 * l_discount AS value FROM li
  UNION ALL SELECT path, 'cyclomatic_method_complexity', routine, '', 'T' || l_linenumber % 2, log2(1 + greatest(0.0, l_quantity - 1) / 9), l_quantity FROM li
  UNION ALL SELECT path, 'npath_complexity', routine, '', '', log2(1 + greatest(0.0, l_extendedprice / 100 - 1) / 199), l_extendedprice / 100 FROM li WHERE path % 11 <> 0
  UNION ALL SELECT path, 'deeply_nested_if', routine, '', '', count(*)::DOUBLE, count(*)::DOUBLE FROM (SELECT path, (l_linenumber % 3)::VARCHAR AS routine FROM li WHERE l_returnflag = 'R') GROUP BY ALL
  UNION ALL SELECT path, 'coupling_between_objects', 'T', '', '', CASE WHEN v >= 20 THEN 1 + log2(v / 20.0) ELSE 0 END, v FROM (SELECT path, sum(l_suppkey % 10) AS v FROM li GROUP BY 1)
  UNION ALL SELECT path, 'cyclomatic_class_complexity', 'T' || l_linenumber % 2, '', '', CASE WHEN sum(2 * l_quantity) >= 80 THEN 1 + log2(sum(2 * l_quantity) / 80) ELSE 0 END, sum(2 * l_quantity) FROM li GROUP BY path, l_linenumber % 2
  UNION ALL SELECT path, 'god_class', 'T', '', '', CASE WHEN w >= 47 AND a > 5 AND t < 100.0::DOUBLE / 3 THEN 30 + 8 * (1 + log2(a / 5.0::DOUBLE)) + 8 * (1 + log2((100.0::DOUBLE / 3) / least(greatest(t, 1.0::DOUBLE), 100.0::DOUBLE / 3))) ELSE 0 END, NULL FROM (SELECT path, sum(l_quantity) AS w, count(DISTINCT l_partkey) AS a, sum(l_tax) * 50 AS t FROM li GROUP BY 1)),
sub AS (SELECT o.*, axis, agg, round(base * w, 12) AS observed, round(base * w2, 12) AS contribution FROM obs o JOIN cov USING (path, component)),
best AS (SELECT path, subject AS grp, component, contribution FROM (SELECT *, row_number() OVER (PARTITION BY path, subject ORDER BY contribution DESC, component) AS nth FROM sub WHERE contribution <> 0 AND component IN ('cognitive_complexity', 'cyclomatic_method_complexity', 'deeply_nested_if', 'npath_complexity')) WHERE nth = 1),
own AS (SELECT path, owner AS subject, sum(contribution) AS charge FROM (SELECT DISTINCT s.path, s.owner, b.grp, b.contribution FROM sub s JOIN best b ON b.path = s.path AND b.grp = s.subject WHERE s.component = 'cyclomatic_method_complexity') GROUP BY ALL),
fin AS (SELECT s.path, s.component, s.agg, s.observed, CASE WHEN s.component = 'cyclomatic_class_complexity' THEN greatest(0.0, s.contribution - coalesce(o.charge, 0)) ELSE s.contribution END AS contribution FROM sub s LEFT JOIN own o ON s.path = o.path AND s.subject = o.subject AND s.component = 'cyclomatic_class_complexity'),
comp AS (SELECT path, component, CASE WHEN any_value(agg) = 'max' THEN max(observed) ELSE sum(observed) END AS observed, CASE WHEN any_value(agg) = 'max' THEN max(contribution) ELSE sum(contribution) END AS contribution FROM fin GROUP BY ALL),
charged AS (SELECT path, component, sum(contribution) AS charged FROM best GROUP BY ALL),
c AS (SELECT path, component, cov.axis, failed, coalesce(observed, 0) AS observed, CASE WHEN component IN ('cognitive_complexity', 'cyclomatic_method_complexity', 'deeply_nested_if', 'npath_complexity') THEN coalesce(charged, 0) ELSE coalesce(contribution, 0) END AS contribution FROM cov LEFT JOIN comp USING (path, component) LEFT JOIN charged USING (path, component))"""


def _inputs(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").withColumn("path", F.col("l_orderkey")).withColumn("owner", F.concat(F.lit("T"), (F.col("l_linenumber") % 2).cast("string")))
    routine = F.col("l_linenumber").cast("string")
    none, text = F.lit(None).cast("double"), F.lit("")

    def rows(df, component, subject, value, owner=text, routine=text, wmc=none, atfd=none, tcc=none):
        named = {"component": F.lit(component), "subject": subject, "routine": routine, "owner": owner, "value": value, "wmc": wmc, "atfd": atfd, "tcc": tcc}
        return df.select("path", *[c.cast("double").alias(n) if n in ("value", "wmc", "atfd", "tcc") else c.alias(n) for n, c in named.items()])

    g = lambda *aggs: li.groupBy("path").agg(*aggs)
    parts = [
        rows(li, "cognitive_complexity", routine, 100 * F.col("l_discount"), F.col("owner")),
        rows(li, "cyclomatic_method_complexity", routine, F.col("l_quantity"), F.col("owner")),
        rows(li, "npath_complexity", routine, F.col("l_extendedprice") / 100),
        rows(li.where("l_returnflag = 'R'"), "deeply_nested_if", text, F.lit(1), routine=(F.col("l_linenumber") % 3).cast("string")),
        rows(g(F.sum(F.col("l_suppkey") % 10).alias("v")), "coupling_between_objects", F.lit("T"), F.col("v")),
        rows(li.groupBy("path", "owner").agg(F.sum(2 * F.col("l_quantity")).alias("v")), "cyclomatic_class_complexity", F.col("owner"), F.col("v")),
        rows(g(F.sum("l_quantity").alias("w"), F.countDistinct("l_partkey").alias("a"), (F.sum("l_tax") * 50).alias("t")), "god_class", F.lit("T"), none, wmc=F.col("w"), atfd=F.col("a"), tcc=F.col("t")),
    ]
    observations = parts[0]
    for p in parts[1:]:
        observations = observations.unionByName(p)
    language = F.element_at(F.array(*[F.lit(x) for x in sf.ALL]), (F.col("path") % 4 + 1).cast("int"))
    files = li.select("path").distinct().withColumn("language", language)
    components = sf.catalog(spark).where("component <> 'module_shallowness'")
    failed = (F.col("path") % 11 == 0) & (F.col("component") == "npath_complexity")
    coverage = files.join(F.broadcast(components.select("component"))).select("path", "component", F.when(failed, "failed").otherwise("complete").alias("state"))
    policy = spark.createDataFrame([("coupling_between_objects", 0.0, None), ("cyclomatic_method_complexity", 9.0, None)], "component string, weight double, enabled boolean")
    return sf.score(files, observations, coverage, components, policy, most=60.0)


@query(f"""WITH {_SQL}, ax AS (SELECT path, axis, sum(contribution) AS v, sum(observed) AS o FROM c GROUP BY ALL), f AS (SELECT path, sum(v) AS score, sum(o) AS observed_score FROM ax GROUP BY 1), ok AS (SELECT path, bool_and(NOT failed) AS complete FROM c GROUP BY 1)
SELECT path, {_LANGUAGE.format('path')} AS language, round(score, 6) AS score, round(observed_score, 6) AS observed_score, complete, complete AND score <= 60 AS passed FROM f JOIN ok USING (path)""")
def file_scores(spark, sf_dir):
    """Every file with its score under a policy, what it would be without grouping, and whether it passes."""
    return _inputs(spark, sf_dir).files.select("path", "language", F.round("score", 6).alias("score"), F.round("observed_score", 6).alias("observed_score"), "complete", "passed")


@query(f"WITH {_SQL} SELECT path, component, axis, CASE WHEN failed THEN 'failed' ELSE 'complete' END AS state, round(observed, 6) AS observed, round(contribution, 6) AS contribution FROM c")
def component_scores(spark, sf_dir):
    """What each component of a file adds to its score, after grouping and residual."""
    return _inputs(spark, sf_dir).components.select("path", "component", "axis", "state", F.round("observed", 6).alias("observed"), F.round("contribution", 6).alias("contribution"))


@query(f"WITH {_SQL} SELECT path, axis, round(sum(contribution), 6) AS value FROM c GROUP BY ALL")
def axis_scores(spark, sf_dir):
    return _inputs(spark, sf_dir).axes.select("path", "axis", F.round("value", 6).alias("value"))


@query(f"""WITH {_SQL}, v AS (SELECT path, component, max(value) AS largest, sum(value) AS total FROM sub GROUP BY ALL)
SELECT path, CASE component WHEN 'cognitive_complexity' THEN 'cog' WHEN 'npath_complexity' THEN 'npath' WHEN 'cyclomatic_method_complexity' THEN 'cyclo' WHEN 'god_class' THEN 'god' WHEN 'coupling_between_objects' THEN 'coupling' ELSE 'nesting' END AS metric,
round(greatest(0, coalesce(CASE component WHEN 'god_class' THEN contribution WHEN 'deeply_nested_if' THEN total ELSE largest END, 0)), 6)::DOUBLE AS value, NOT failed AS available FROM c LEFT JOIN v USING (path, component) WHERE component <> 'cyclomatic_class_complexity'""")
def view_metrics(spark, sf_dir):
    """The metrics of a view and whether they are available."""
    return sf.metrics(_inputs(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(f"""WITH {_SQL}, f AS (SELECT path, sum(contribution) AS score, bool_and(NOT failed) AS complete FROM c GROUP BY 1)
SELECT count(*)::BIGINT AS files_analyzed, count(*) FILTER (complete)::BIGINT AS complete_files, count(*) FILTER (NOT complete)::BIGINT AS failed_files, bool_and(complete AND score <= 60) AS passed FROM f""")
def score_summary(spark, sf_dir):
    return sf.summary(_inputs(spark, sf_dir).files)
