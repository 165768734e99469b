"""Queries over all rows of their tables: nothing is left out."""

from collections import Counter

import pandas as pd

from plumbline.plans import catalog, facts  # noqa: F401

SF = "/root/testdata/sf0.001"


def table(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def run(spark, name):
    return catalog.QUERIES[name](spark, SF).toPandas()


def test_every_place(spark):
    c, o = table("customer"), table("orders")
    got = run(spark, "view_sort_missing_last").sort_values("place")
    best = o.groupby("o_custkey").o_totalprice.max()
    want = sorted(c.c_custkey, key=lambda k: (-best.get(k, float("-inf")), k))
    assert list(got.c_custkey) == want and list(got.place) == list(range(1, len(c) + 1))
    o = o[(o.o_orderstatus != "P") & ~((o.o_orderstatus == "F") & (o.o_custkey % 2 == 0))]
    got = run(spark, "job_view")
    assert len(o) > 100 and set(got.id) == set(o.o_orderkey) and sorted(got.place) == list(range(1, len(o) + 1))


def test_every_unit(spark):
    e = table("events")
    units = run(spark, "unit_components")
    assert set(e.user_id) <= set(units.id) and 1 < units.component.nunique() < len(units)
    assert {u for u in e.user_id if u % 16 == 1} <= set(run(spark, "affected_units").node)
    edges, seen, todo = {}, {3}, [3]
    for u, i in zip(e.user_id, e.event_id):
        edges.setdefault(u, set()).add(i % (e.user_id.max() + 1))
    while todo:
        fresh = edges.get(todo.pop(), set()) - seen
        seen |= fresh
        todo += fresh
    assert set(run(spark, "unit_closure").node) == seen


def test_every_candidate(spark):
    li = table("lineitem")
    by_name, by_owner = li.groupby("l_partkey").l_linenumber.agg(set).to_dict(), li.groupby(["l_partkey", "l_suppkey"]).l_linenumber.agg(set).to_dict()
    want = Counter()
    for r in li.itertuples():
        found = by_owner.get((r.l_partkey, r.l_suppkey + r.l_linenumber % 2)) or by_name[r.l_partkey]
        want[r.l_orderkey, r.l_linenumber, min(found) if len(found) == 1 else None] += 1
    got = run(spark, "call_targets")
    assert Counter((r.l_orderkey, r.l_linenumber, None if pd.isna(r.callee) else int(r.callee)) for r in got.itertuples()) == want
    assert got.callee.notna().any() and got.callee.isna().any()
