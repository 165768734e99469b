"""Queries on control flow: dominators, loops and resources of all routines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow, method_sets
from .catalog import _t, query

# A routine is an order, its blocks are the lines; each leads to the next, and some to another one.
_GRAPH = """WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS routine, l_linenumber AS node, max(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber) AS part FROM lineitem),
n AS (SELECT routine, max(node) AS last FROM l GROUP BY 1),
e AS (SELECT routine, node AS src, node + 1 AS dst FROM l JOIN n USING (routine) WHERE node < last UNION SELECT routine, node, 1 + part % last FROM l JOIN n USING (routine) WHERE part % 3 > 0),
reach AS (SELECT routine, 1 AS node FROM n UNION SELECT reach.routine, e.dst FROM reach JOIN e ON e.routine = reach.routine AND e.src = reach.node),
without AS (SELECT routine, node AS gone, 1 AS node FROM reach WHERE node <> 1 UNION SELECT w.routine, w.gone, e.dst FROM without w JOIN e ON e.routine = w.routine AND e.src = w.node AND e.dst <> w.gone),
dom AS (SELECT r.routine, r.node, d.node AS dom FROM reach r JOIN reach d ON d.routine = r.routine WHERE d.node = r.node OR NOT EXISTS (SELECT 1 FROM without w WHERE w.routine = r.routine AND w.gone = d.node AND w.node = r.node))"""


def _graph(spark, sf_dir):
    """(edges, entries) of all orders."""
    li = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("routine"), F.col("l_linenumber").alias("node")).agg(F.max("l_partkey").alias("part"))
    last = li.groupBy("routine").agg(F.max("node").alias("last"))
    j = li.join(last, "routine")
    on = F.when(F.col("node") < F.col("last"), F.col("node") + 1)
    to = F.when(F.col("part") % 3 > 0, (1 + F.col("part") % F.col("last")).cast("int"))
    edges = j.select("routine", F.col("node").alias("src"), F.explode(F.array_compact(F.array(on, to))).alias("dst"))
    return edges, last.select("routine", F.lit(1).alias("entry"))


@query(_GRAPH + """, s AS (SELECT routine, node, count(*) - 1 AS depth FROM dom GROUP BY 1, 2)
SELECT s.routine, s.node, (SELECT arg_max(d.dom, t.depth) FROM dom d JOIN s t ON t.routine = d.routine AND t.node = d.dom WHERE d.routine = s.routine AND d.node = s.node AND d.dom <> d.node) AS idom, depth FROM s""")
def dominator_tree(spark, sf_dir):
    """The closest dominator of every block."""
    return flow.dominator_tree(*_graph(spark, sf_dir))


@query(_GRAPH + """, b AS (SELECT e.routine, e.dst AS header, e.src FROM e JOIN dom ON dom.routine = e.routine AND dom.node = e.src AND dom.dom = e.dst),
body AS (SELECT routine, header, header AS node FROM b UNION SELECT routine, header, src FROM b UNION SELECT body.routine, header, e.src FROM body JOIN e ON e.routine = body.routine AND e.dst = body.node JOIN reach r ON r.routine = e.routine AND r.node = e.src WHERE body.node <> header),
z AS (SELECT routine, header, count(*) AS size FROM body GROUP BY 1, 2),
q AS (SELECT routine, node, count(*) AS loops, min({'size': size, 'header': header}).header AS header FROM body JOIN z USING (routine, header) GROUP BY 1, 2)
SELECT r.routine, r.node, coalesce(loops, 0)::BIGINT AS loops, header FROM reach r LEFT JOIN q USING (routine, node)""")
def loop_nesting(spark, sf_dir):
    """How many loops each block is in, and the header of the innermost."""
    return flow.loop_nesting(*_graph(spark, sf_dir))


@query(_GRAPH + """, ev AS (SELECT l_orderkey AS routine, l_linenumber AS node, l_partkey AS pos, l_suppkey % 3 AS resource, l_quantity > 20 AS acquire FROM lineitem),
last AS (SELECT routine, node, resource, arg_max(acquire, pos) AS acquire FROM ev GROUP BY 1, 2, 3),
held AS (SELECT l.routine, l.resource, l.node FROM last l JOIN reach r USING (routine, node) WHERE acquire UNION SELECT h.routine, h.resource, e.dst FROM held h JOIN e ON e.routine = h.routine AND e.src = h.node WHERE NOT EXISTS (SELECT 1 FROM last k WHERE k.routine = h.routine AND k.resource = h.resource AND k.node = e.dst AND NOT k.acquire)),
x AS (SELECT r.routine, r.node FROM reach r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.routine = r.routine AND e.src = r.node)),
a AS (SELECT ev.routine, resource, count(*) AS acquired FROM ev JOIN reach r USING (routine, node) WHERE acquire GROUP BY 1, 2),
o AS (SELECT h.routine, resource, count(DISTINCT h.node) AS held, array_to_string(list_sort(list(DISTINCT h.node))[:32], ',') AS exits_held FROM held h JOIN x ON x.routine = h.routine AND x.node = h.node GROUP BY 1, 2),
c AS (SELECT routine, count(*) AS exits FROM x GROUP BY 1)
SELECT a.routine, a.resource, acquired, coalesce(exits, 0)::BIGINT AS exits, coalesce(held, 0)::BIGINT AS held, coalesce(exits_held, '') AS exits_held, held IS NULL AND exits IS NOT NULL AS released FROM a LEFT JOIN o USING (routine, resource) LEFT JOIN c USING (routine)""")
def released_resources(spark, sf_dir):
    """The resources that every way to an exit releases, and those that are still held at some.  Of lines of one part the first in the
    table counts, as in the SQL."""
    edges, entries = _graph(spark, sf_dir)
    kind = F.when(F.col("l_quantity") > 20, "acquire").otherwise("release")
    pos = F.struct("l_partkey", (-F.col("_metadata.row_index")).alias("first"))
    events = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("routine"), F.col("l_linenumber").alias("node"), pos.alias("pos"), (F.col("l_suppkey") % 3).alias("resource"), kind.alias("kind"))
    out = flow.held_at_exits(edges, entries, events)
    return out.withColumn("exits_held", F.array_join("exits_held", ","))


@query("""WITH RECURSIVE t AS (SELECT c_custkey AS type FROM customer), e AS (SELECT c_custkey AS type, c_custkey // 2 AS embedded FROM customer WHERE c_custkey > 1 UNION ALL SELECT o_custkey, o_custkey // 3 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey > 2 GROUP BY 1, 2),
m AS (SELECT DISTINCT o_custkey AS type, o_orderkey % 20 AS name, 'method' AS kind FROM orders UNION ALL SELECT c_custkey, 10 + c_nationkey, 'field' FROM customer),
w AS (SELECT type, type AS holder, 0 AS depth FROM t UNION ALL SELECT w.type, e.embedded, depth + 1 FROM w JOIN e ON e.type = w.holder),
l AS (SELECT w.type, name, depth, count(*) AS n, min(holder) AS origin, min(kind) AS kind FROM w JOIN m ON m.type = w.holder GROUP BY 1, 2, 3),
f AS (SELECT type, name, min(depth) AS depth FROM l GROUP BY 1, 2)
SELECT type, name, origin, depth FROM l JOIN f USING (type, name, depth) WHERE n = 1 AND kind = 'method'""")
def promoted_methods(spark, sf_dir):
    """Methods of every type through the types it embeds; customers are types that embed others of smaller numbers."""
    c, o = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    types = c.select(F.col("c_custkey").alias("type"))
    up = lambda key, by: F.floor(F.col(key) / by).cast("long").alias("embedded")
    urgent = o.where("o_orderpriority = '1-URGENT' AND o_custkey > 2").select(F.col("o_custkey").alias("type"), up("o_custkey", 3)).distinct()
    embeds = c.where("c_custkey > 1").select(F.col("c_custkey").alias("type"), up("c_custkey", 2)).unionByName(urgent)
    methods = o.select(F.col("o_custkey").alias("type"), (F.col("o_orderkey") % 20).cast("long").alias("name"), F.lit("method").alias("kind"))
    fields = c.select(F.col("c_custkey").alias("type"), (10 + F.col("c_nationkey")).cast("long").alias("name"), F.lit("field").alias("kind"))
    return method_sets.method_sets(types, methods.unionByName(fields), embeds)
