"""Unit graphs, interface shape and streams against plain versions."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import graph, incremental, shape
from plumbline.streaming import ranks


def reach(nodes, edges):
    out = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            if a in out and b in out:
                out[a] |= out[b]
    return out


@pytest.mark.parametrize("seed,n,m", [(1, 12, 16), (2, 9, 4), (3, 10, 30)])
def test_components(spark, seed, n, m):
    r = random.Random(seed)
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)] + [(0, 99), (1, 1)]
    far = reach(range(n), edges)
    want = {x: min(y for y in far[x] if x in far[y]) for x in range(n)}
    got = graph.components(spark.createDataFrame([(i,) for i in range(n)], "id long"), spark.createDataFrame(edges, "src long, dst long"))
    assert {x.id: x.component for x in got.collect()} == want


def test_fingerprints_follow_dependencies(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (5, 4), (6, 6)], "src long, dst long")

    def run(changed=None):
        units = spark.createDataFrame([(i, f"k{i}" + "x" * (i == changed)) for i in range(1, 8)], "id long, key string")
        return {r.id: (r.component, r.fingerprint) for r in graph.fingerprints(units, edges).collect()}

    base = run()
    assert {i: c for i, (c, _) in base.items()} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 7} and base[2] == base[3] and base == run()
    after = run(4)
    assert {i for i in base if base[i] != after[i]} == {1, 2, 3, 4, 5}
    after = run(3)
    assert {i for i in base if base[i] != after[i]} == {1, 2, 3}


def test_closure_of_a_long_chain(spark):
    edges = spark.range(105).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = incremental.closure(spark, edges.coalesce(1), spark.createDataFrame([(0,)], "node long").coalesce(1))
    assert sorted(r.node for r in got.collect()) == list(range(106))


def test_affected_context_and_changes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "a"), ("e", "f"), ("f", "e")], "src string, dst string")
    changed = spark.createDataFrame([("x.go", "go")], "path string, language string")
    consumers = spark.createDataFrame([("x.go", "b"), ("y.go", "e")], "path string, unit string")
    conservative = spark.createDataFrame([("go", "z"), ("rust", "w")], "language string, unit string")
    assert {r.node for r in graph.affected(spark, changed, consumers, conservative, edges).collect()} == {"b", "a", "d", "z"}
    sources = spark.createDataFrame([("a", "1"), ("b", "1"), ("b", "2"), ("c", "3")], "unit string, path string")
    assert {tuple(r) for r in graph.context_sources(edges, sources).collect()} == {("a", "2"), ("b", "3"), ("d", "1")}
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, size int, mtime int")
    new = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("d", 1, 1)], "path string, size int, mtime int")
    assert {tuple(r) for r in graph.changed_files(old, new).collect()} == {("b", "stamped"), ("c", "removed"), ("d", "added")}


def test_shape(spark):
    ops = spark.createDataFrame([("a", 0, 0, False, False, 0.0, 0), ("b", 2, 1, False, False, 4.0, 1), ("b", 0, 0, True, True, 0.0, 0), ("c", 1, 1, False, False, 2.0, 0)], "path string, parameters int, results int, emits boolean, mutates boolean, type_cost double, exposed int")
    types = spark.createDataFrame([("c", "Reader", "interface", 0, 0), ("d", "Point", "struct", 2, 2), ("e", "hidden", "struct", 3, 3)], "path string, name string, kind string, public_fields int, mutable_fields int")
    exposures = spark.createDataFrame([("b",)] * 3, "path string")
    got = {r.path: (r.role, r.penalty) for r in shape.module_shallowness(ops, types, exposures).collect()}

    def penalty(f, c, x, prior, confidence, n):
        ref = 1 + (prior - 1) * confidence * min(1, n / 4)
        return int(min(100, 80 * max(0, 1 - f / c / ref) + 20 * min(1, x / c)) + 0.5)

    assert got["a"] == ("command", penalty(1, 1, 0, 1.12, 0.9, 1))
    # two operations with results, one of which changes something: one in three, but one is allowed
    assert got["b"] == ("query", penalty(2 + 1 + 1 + 1, 2 + 4, 3, 1.05, 0.85, 2))
    assert got["c"] == ("protocol", penalty(2, 1 + 2 + 1, 0, 0.72, 1, 2))
    assert got["d"] == ("data", penalty(0, 1 + 2, 2, 0.85, 1, 1)) and got["e"] == ("unknown", None)
    one = spark.range(1).select(shape.graded(F.lit(3.0), F.lit(2.25), F.lit(1.0), F.lit(0.5)), shape.graded(F.lit(3.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)), shape.plain(F.lit(3.25), F.lit(1.0)), shape.responsibility_ratio(F.lit(3.0), F.lit(1.0)), shape.responsibility_ratio(F.lit(0.0), F.lit(0.0))).first()
    assert tuple(one) == (75.0, 0.0, 40.0, 60.0, 0.0)
    found = spark.createDataFrame([("a", "k", "o", "p", 1.0), ("a", "k", "o", "p", 1.0), ("a", "k", "o", "q", 0.5), ("a", "k", "o", "r", -9.0)], "path string, kind string, operation string, parameter string, adverse double")
    burdens = spark.createDataFrame([("a", 4.0), ("b", 2.0), ("c", 0.0)], "path string, burden double")
    assert {r.path: r.penalty for r in shape.finding_penalty(found, burdens).collect()} == {"a": 38.0, "b": 0.0, "c": 0.0}


def test_rank_points():
    t = lambda m: pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)
    rows = [(t(0), 5, 1.0), (t(1), 5, 2.0), (t(2), 3, 2.0), (t(3), 2, 4.0), (t(30), 7, 4.0), (t(31), 7, 3.0)]
    want = [(1, 0, 0), (1, 0, 1), (2, 0, 1), (3, 3, 1), (1, 3, 1), (1, 0, -1)]
    state, out = ranks.fold(None, rows, pd.Timedelta("10 minutes"))
    assert [o[3:] for o in out] == want
    parts = []
    state = None
    for r in rows:
        state, o = ranks.fold(state, [r], pd.Timedelta("10 minutes"))
        parts += o
    assert parts == out


def test_rank_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", 2, 1.0), ("b", "2024-01-01 00:00:00", 1, 3.0), ("a", "2024-01-01 00:01:00", 1, 5.0), ("b", "2024-01-01 00:01:00", 2, 3.0)]
    df = spark.createDataFrame(rows, "path string, t string, rank int, score double").withColumn("at", F.to_timestamp("t")).drop("t")
    src = str(tmp_path / "in")
    q = None
    try:
        df.where("at < '2024-01-01 00:00:30'").write.mode("append").parquet(src)
        q = ranks.rank_history(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("rank_points").option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        df.where("at > '2024-01-01 00:00:30'").write.mode("append").parquet(src)
        q.processAllAvailable()
        got = {(r.path, r.rank, r.points, r.movement, r.direction) for r in spark.table("rank_points").collect()}
    finally:
        if q:
            q.stop()
    assert got == {("a", 2, 1, 0, 0), ("b", 1, 1, 0, 0), ("a", 1, 2, 1, 1), ("b", 2, 2, 0, 0)}


def test_views_of_a_stream(spark):
    old, new = (spark.createDataFrame(x, "path string, bin int") for x in ([("a", 1), ("b", 1)], [("a", 2), ("b", 1), ("c", 1)]))
    assert {tuple(r) for r in ranks.histogram_moves(old, new).collect()} == {(1, 0)} - {(1, 0)} | {(2, 1)}
    rows = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y"), ("t", 1, "z")], "scope string, generation int, v string")
    assert {r.v for r in ranks.current(rows).collect()} == {"y", "z"}
    ev = spark.createDataFrame([("u", 1, "verify"), ("u", 2, "changed"), ("u", 3, "failed"), ("v", 1, "done"), ("w", 2, "done"), ("w", 1, "verify")], "unit string, at int, event string")
    assert {r.unit: r.state for r in ranks.freshness(ev).collect()} == {"u": "stale_error", "v": "provisional", "w": "current"}
    obs = spark.createDataFrame([("a", "x", "complete"), ("a", "y", "running"), ("b", "x", "failed")], "path string, component string, state string")
    exp = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "path string, component string")
    assert {r.path: (r.pending, r.complete) for r in ranks.partial(obs, exp).collect()} == {"a": (["y"], False), "b": ([], True)}
