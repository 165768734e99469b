"""Dominators, loops and held resources of random graphs against reachability and all paths; method sets; a histogram on a stream."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import flow, method_sets
from plumbline.streaming import histograms


def graphs(seed, n=60):
    rng = random.Random(seed)
    out = {}
    for r in range(n):
        k = rng.randint(1, 9)
        edges = {(i, i + 1) for i in range(k - 1) if rng.random() < 0.8} | {(rng.randrange(k), rng.randrange(k)) for _ in range(rng.randint(0, k))}
        out[r] = (k, edges)
    return out


def reach(edges, start, gone=None):
    seen, todo = set(), [start] if start != gone else []
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += [b for a, b in edges if a == x and b != gone]
    return seen


@pytest.fixture(scope="module")
def graph(spark):
    g = graphs(4)
    rows = [(r, a, b) for r, (_, e) in g.items() for a, b in e] * 2
    return g, spark.createDataFrame(rows, "routine int, src int, dst int"), spark.createDataFrame([(r, 0) for r in g], "routine int, entry int")


def test_dominators_and_loops(graph):
    g, edges, entries = graph
    dom = flow.dominators(edges, entries)
    got = {(r.routine, r.node, r.dom) for r in dom.collect()}
    want = {(r, n, d) for r, (k, e) in g.items() for n in reach(e, 0) for d in range(k) if n not in reach(e, 0, d)}
    assert got == want
    size = collections.Counter((r, n) for r, n, _ in want)
    tree = {(r.routine, r.node): (r.idom, r.depth) for r in flow.immediate(dom).collect()}
    for (r, n), (idom, depth) in tree.items():
        strict = [d for x, m, d in want if (x, m) == (r, n) and d != n]
        assert depth == len(strict) and idom == (max(strict, key=lambda d: size[r, d]) if strict else None)
    bodies = {}
    for r, (_, e) in g.items():
        alive = reach(e, 0)
        for a, h in e:
            if a in alive and (r, a, h) in want:
                back = reach({(y, x) for x, y in e if x in alive and y in alive and y != h}, a)
                bodies.setdefault((r, h), {h}).update(back | {a})
    loop = flow.loops(edges, dom)
    assert {(r.routine, r.header, r.node) for r in loop.collect()} == {(r, h, n) for (r, h), b in bodies.items() for n in b}
    for x in flow.nesting(dom, loop).collect():
        mine = [(len(b), h) for (r, h), b in bodies.items() if r == x.routine and x.node in b]
        assert (x.loops, x.header) == (len(mine), min(mine)[1] if mine else None)


def test_held_resources(spark, graph):
    """All ways through a graph, as far as they come to new (block, held) pairs; more resources than a word has bits."""
    g, edges, entries = graph
    rng = random.Random(9)
    events = [(r, rng.randrange(k), i, f"r{rng.randrange(150 if r == 0 else 3)}", rng.choice(["acquire", "release"])) for r, (k, _) in g.items() for i in range(400 if r == 0 else rng.randint(0, 7))]
    got = {(r.routine, r.resource): r for r in flow.held_at_exits(edges, entries, spark.createDataFrame(events, "routine int, node int, pos int, resource string, kind string")).collect()}
    names = {(r, s) for r, n, _, s, kind in events if kind == "acquire" and n in reach(g[r][1], 0)}
    assert set(got) == names
    for r, s in names:
        _, e = g[r]
        after = {}
        for x in sorted((x for x in events if x[0] == r and x[3] == s), key=lambda x: x[2]):
            after[x[1]] = x[4] == "acquire"
        seen, todo = set(), [(0, after.get(0, False))]
        while todo:
            at = todo.pop()
            if at not in seen:
                seen.add(at)
                todo += [(b, after.get(b, at[1])) for a, b in e if a == at[0]]
        exits = {n for n in reach(e, 0) if not any(a == n for a, _ in e)}
        held = sorted(n for n, h in seen if h and n in exits)
        x = got[r, s]
        assert (x.held, x.exits_held, x.exits, x.released) == (len(held), held[: flow.WITNESSES], len(exits), not held and bool(exits))
        assert x.acquired == sum(y[0] == r and y[3] == s and y[4] == "acquire" and y[1] in reach(e, 0) for y in events)


def test_flow_of_nothing(spark):
    edges, entries = spark.createDataFrame([], "routine int, src int, dst int"), spark.createDataFrame([(1, 5)], "routine int, entry int")
    dom = flow.dominators(edges, entries)
    assert [tuple(r) for r in dom.collect()] == [(1, 5, 5)] and flow.loops(edges, dom).count() == 0
    assert flow.dominators(edges, entries.limit(0)).count() == 0


def test_method_sets(spark):
    embeds = [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D"), ("C", "E"), ("F", "F"), ("G", "H"), ("H", "G"), ("A", None)]
    members = [("A", "own", "method"), ("B", "both", "method"), ("C", "both", "method"), ("D", "twice", "method"), ("E", "once", "method"), ("D", "both", "method"), ("B", "hidden", "field"), ("E", "hidden", "method"), ("F", "f", "method"), ("G", "g", "method"), ("H", "g", "method"), ("H", "h", "method"), ("E", None, "method")]
    types = spark.createDataFrame([(t,) for t in "ABCDEFGH"] + [(None,)], "type string")
    got = method_sets.method_sets(types, spark.createDataFrame(members, "type string, name string, kind string"), spark.createDataFrame(embeds, "type string, embedded string"))
    of = collections.defaultdict(set)
    for r in got.collect():
        of[r.type].add((r.name, r.origin, r.depth))
    assert of["A"] == {("own", "A", 0), ("once", "E", 2)}  # both cancels, twice comes in two ways, a field hides hidden
    assert of["B"] == {("both", "B", 0), ("twice", "D", 1)} and of["C"] == {("both", "C", 0), ("twice", "D", 1), ("once", "E", 1), ("hidden", "E", 1)}
    assert of["F"] == {("f", "F", 0)} and of["G"] == {("g", "G", 0), ("h", "H", 1)} and of["H"] == {("g", "H", 0), ("h", "H", 0)}


def test_histogram_on_a_stream(spark, tmp_path):
    rng = random.Random(1)
    log, folder = tmp_path / "log", f"file://{tmp_path}/state"
    log.mkdir()
    now = {}
    for i in range(4):
        rows = [(f"p{rng.randrange(30)}", i * 100 + j, rng.choice([None, 3.0, 12.5, 47.0, 500.0])) for j in range(25)]
        now |= {p: s for p, _, s in rows}
        (log / f"{i}.json").write_text("\n".join(json.dumps({"path": p, "at": at, "score": s}) for p, at, s in rows))
        scores = spark.readStream.schema("path string, at long, score double").json(str(log))
        histograms.follow(scores, folder, str(tmp_path / "cp"), availableNow=True).awaitTermination()
        want = dict(collections.Counter(min(20, int(s // 5)) for s in now.values() if s is not None))
        result = lambda: {r.bin: r.files for r in histograms.histogram(spark, folder).collect()}
        assert result() == want
        again = spark.read.schema(scores.schema).json(str(log / f"{i}.json"))
        histograms.add_batch(again, i, folder)  # the last batch is given once more
        assert result() == want
        if i == 1:
            histograms.fold(spark, folder)
            histograms.add_batch(again, 0, folder)  # what a fold holds counts no more
            assert result() == want


def test_rounds_leave_one_table(spark, tmp_path, monkeypatch):
    """Operators with rounds delete all that they wrote but their result, also within each other and when they fail."""
    from plumbline import scratch
    from plumbline.operators import graph as g
    from plumbline.operators import incremental

    monkeypatch.setattr(scratch, "root", lambda _: f"file://{tmp_path}")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    units = spark.createDataFrame([(i, f"k{i}") for i in range(1, 6)], "id long, key string")
    assert {(r.id, r.component) for r in g.components(units, edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)} and len(list(tmp_path.iterdir())) == 1
    assert g.fingerprints(units, edges).count() == 5 and len(list(tmp_path.iterdir())) == 2
    assert incremental.closure(spark, edges, units.where("id = 4").select(F.col("id").alias("node"))).count() == 2 and len(list(tmp_path.iterdir())) == 3
    with pytest.raises(Exception, match="nothing"):
        g.components(units, edges.withColumn("src", F.raise_error(F.lit("nothing")).cast("long")))
    assert len(list(tmp_path.iterdir())) <= 4  # at most the table whose write failed
