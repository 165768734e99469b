"""From source texts to metrics: the lines of an order are the statements of a Go file."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import syntax
from ..scratch import cut
from ..sources import curly, golang
from .catalog import _t, query


def _files(spark, sf_dir):
    """A file for each order, in a directory for each hundred; every seventeenth can't be read."""
    one = F.when(F.col("l_returnflag") == "R", "\tif a {\n\t}\n").when(F.col("l_returnflag") == "A", "\tfor i := range b {\n\t\tif c && d { continue }\n\t}\n").otherwise("\tx.n++\n")
    text = F.concat(F.lit("package p\n\ntype T struct { n int }\n\n"), F.when(F.col("k") % 17 == 0, "func {\n").otherwise("func (x *T) F() {\n"), F.array_join("lines", ""), F.lit("}\n"))
    g = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(one).alias("lines"))
    path = F.concat(F.expr("CAST(k DIV 100 AS string)"), F.lit("/"), F.col("k").cast("string"), F.lit(".go"))
    return g.select(path.alias("path"), text.alias("content"))


_PATH = "(l_orderkey // 100) || '/' || l_orderkey || '.go'"


@query(f"""SELECT {_PATH} AS path, 'T.F' AS fn, (1 + count(*) FILTER (l_returnflag = 'R') + 4 * count(*) FILTER (l_returnflag = 'A'))::BIGINT AS cyclomatic,
(count(*) FILTER (l_returnflag = 'R') + 4 * count(*) FILTER (l_returnflag = 'A'))::BIGINT AS cognitive FROM lineitem WHERE l_orderkey % 17 <> 0 GROUP BY l_orderkey""")
def source_metrics(spark, sf_dir):
    """Complexity of the routines of all files that can be read."""
    return syntax.measure(golang.routines(golang.facts(_files(spark, sf_dir)))).select("path", "fn", "cyclomatic", "cognitive")


@query("""SELECT l_orderkey || '.java' AS path, (1 + count(*) FILTER (l_returnflag = 'R') + 4 * count(*) FILTER (l_returnflag = 'A'))::BIGINT AS cyclomatic,
(count(*) FILTER (l_returnflag = 'R') + 4 * count(*) FILTER (l_returnflag = 'A'))::BIGINT AS cognitive FROM lineitem GROUP BY l_orderkey""")
def java_metrics(spark, sf_dir):
    """The same statements as a Java method."""
    one = F.when(F.col("l_returnflag") == "R", "if (a) { }").when(F.col("l_returnflag") == "A", "for (X i : b) { if (c && d) continue; }").otherwise("x.n++;")
    text = F.concat(F.lit("class T { void f() { "), F.array_join(F.collect_list(one), "\n"), F.lit(" } }"))
    g = _t(spark, sf_dir, "lineitem").groupBy(F.concat(F.col("l_orderkey").cast("string"), F.lit(".java")).alias("path")).agg(text.alias("content"))
    return syntax.measure(curly.routines(g.withColumn("language", F.lit("java")))).select("path", "cyclomatic", "cognitive")


@query(f"""WITH f AS (SELECT DISTINCT l_orderkey AS k, {_PATH} AS path FROM lineitem), b AS (SELECT DISTINCT k // 100 AS d FROM f WHERE k % 17 = 0)
SELECT path, component, CASE WHEN k % 17 = 0 THEN 'failed' WHEN component = 'god_class' AND d IS NOT NULL THEN 'unavailable' ELSE 'complete' END AS state FROM f CROSS JOIN (VALUES ('cognitive_complexity'), ('god_class')) c(component) LEFT JOIN b ON d = k // 100""")
def source_coverage(spark, sf_dir):
    """What was measured of each file: a file that can't be read makes class metrics of its directory unavailable."""
    files = _files(spark, sf_dir)
    return golang.coverage(files, cut(golang.failures(golang.facts(files))), ["cognitive_complexity", "god_class"], ["god_class"])
