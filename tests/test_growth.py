"""Cases of the third review that are about growth: less is written or run, the results are the same."""

import random

import pytest


def _method_sets(types, members, embeds):
    """Level by level from each type, as its docstring says."""
    out = set()
    for t in types:
        level, seen, taken, depth = {t: 1}, {t}, set(), 0
        while level:
            met = {}
            for holder, ways in level.items():
                for name, kind in members.get(holder, ()):
                    met.setdefault(name, []).append((ways, holder, kind))
            out |= {(t, name, m[0][1], depth) for name, m in met.items() if name not in taken and len(m) == 1 and m[0][0] == 1 and m[0][2] == "method"}
            taken |= set(met)
            below = {}
            for holder, ways in level.items():
                for e in embeds.get(holder, ()):
                    if e not in seen:
                        below[e] = below.get(e, 0) + ways
            seen |= set(below)
            level, depth = below, depth + 1
    return out


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_method_sets_against_walks(spark, monkeypatch, few):
    from plumbline.operators import method_sets as ms

    monkeypatch.setattr(ms, "FEW_ROWS", few)
    r = random.Random(5)
    embeds = [(r.randrange(30), r.randrange(30)) for _ in range(50)]
    members = [(r.randrange(32), f"n{r.randrange(9)}", r.choice(["method", "method", "field"])) for _ in range(40)]
    types = range(25)
    of, up = {}, {}
    for t, *m in set(members):
        of.setdefault(t, []).append(tuple(m))
    for t, e in embeds:
        up.setdefault(t, []).append(e)
    df = spark.createDataFrame
    got = ms.method_sets(df([(t,) for t in types] * 2, "type long"), df(members, "type long, name string, kind string"), df(embeds, "type long, embedded long"))
    want = _method_sets(types, of, up)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and {d for *_, d in want} > {0, 1, 2}


def test_method_sets_of_a_deep_chain(spark, monkeypatch):
    """Every type below another one was a row, also where all its names were hidden."""
    from plumbline.operators import method_sets as ms

    rows, cut = [], ms.cut

    def counted(df, *made):
        out = cut(df, *made)
        rows.append(out.count())
        return out

    monkeypatch.setattr(ms, "cut", counted)
    n, df = 30, spark.createDataFrame
    out = ms.method_sets(df([(i,) for i in range(n)], "type long"), df([(i, "m", "method") for i in range(n)], "type long, name string, kind string"), df([(i, i + 1) for i in range(n - 1)], "type long, embedded long"))
    assert out.count() == n and sum(rows) < 5 * n


def _graphs(spark):
    """Random routines of up to nine nodes, one of 71, one that repeats an edge 5,000 times."""
    r = random.Random(7)
    rows = [(n, r.randrange(k), r.randrange(k)) for n in range(40) for k in [r.randint(1, 9)] for _ in range(r.randint(0, 2 * k))]
    rows += [(90, 0, i + 1) for i in range(70)] + [(90, 60, 5), (90, 5, 60), (90, 30, 30)] + [(91, 0, 1)] * 5000 + [(91, 1, 0), (91, None, 0), (92, 3, None)]
    edges = spark.createDataFrame(rows, "routine int, src int, dst int")
    entries = spark.createDataFrame([(n, 0) for n in [*range(40), 90, 91, 92]] + [(7, 1)], "routine int, entry int")
    events = [(n, r.randrange(9), i, r.choice("abc"), r.choice(["acquire", "release"])) for n in [*range(40), 90, 91, 92] for i in range(r.randint(0, 9))]
    events += [(3, r.randrange(3), i, f"r{i}", "acquire") for i in range(80)] + [(4, 0, 1, None, "acquire")]
    return edges, entries, spark.createDataFrame(events, "routine int, node int, pos int, resource string, kind string")


def test_routines_of_one_row_and_by_rounds(spark):
    """Both ways give the same, also where some routines go one way and some the other."""
    from plumbline.operators import flow

    edges, entries, events = _graphs(spark)
    got = lambda df: sorted(map(repr, map(tuple, df.collect())))
    sound = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    dom = flow._dominators(sound, entries)
    assert got(flow.dominators(edges, entries)) == got(dom)
    assert got(flow.dominator_tree(edges, entries)) == got(flow.immediate(dom))
    assert got(flow.loop_nesting(edges, entries)) == got(flow.nesting(dom, flow.loops(sound, dom)))
    a, b = flow.held_at_exits(edges, entries, events), flow._held_at_exits(sound, entries, events)
    assert a.dtypes == b.dtypes and got(a) == got(b)


@pytest.mark.parametrize("name", ["dominator_tree", "loop_nesting", "released_resources"])
def test_small_routines_take_no_rounds(spark, monkeypatch, name):
    """Each round wrote tables; now there are the graphs, what was found in them, and the result."""
    from plumbline import scratch
    from plumbline.operators import flow
    from plumbline.plans import catalog

    made = []
    for module in (flow, scratch):
        monkeypatch.setattr(module, "cut", lambda df, *more, cut=scratch.cut: made.append(1) or cut(df, *more))
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0 and len(made) <= 3


def test_equal_go_files(spark):
    """Copies have the same facts under their own paths; large ones, nulls and unreadable ones too."""
    from plumbline.sources import golang

    texts = {"a": "package p\n\nfunc F() {\n\tx()\n}\n", "b": "package p\n\nfunc {\n", "c": "package p\n\n// " + "x" * 5000 + "\nfunc G() {\n}\n", "d": None}
    rows = [(f"{k}{i}", t) for k, t in texts.items() for i in range(20)]
    out = golang.facts(spark.createDataFrame(rows, "path string, content string").coalesce(1)).collect()
    assert sorted((r.path, r.what, r.name) for r in out) == sorted((p, "failure" if p[0] in "bd" else "routine", {"a": "F", "c": "G"}.get(p[0])) for p, _ in rows)
