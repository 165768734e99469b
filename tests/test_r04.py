"""Cases of the fourth review."""

import random

import pytest


def _tables(spark):
    """Findings and routines: nested, disjoint, touching, crossing, repeated, empty and half ranges, null paths and symbols."""
    r = random.Random(11)
    routines = []
    for path in range(60):
        for n in range(r.randrange(6)):
            mid = r.choice([50, 50, 20, 80])
            lo, hi = (mid - 8 * n - 1, mid + 8 * n + 1) if path % 3 else (r.randrange(90), r.randrange(100))
            routines.append((path, f"n{n}", r.choice(["a", "b", "", None]), lo, hi))
    for path, ranges in {60: [(1, 5), (5, 9), (5, 7), (0, 20)], 61: [(3, 3)], 62: [(1, 9), (1, 9)], 63: [(None, None)], 64: [(1, 9), (5, None)], 65: [(1, 9), (None, 9)], 66: [(None, 4), (5, 9)], None: [(1, 9), (2, 4)]}.items():
        routines += [(path, f"m{i}", "a", *x) for i, x in enumerate(ranges)]
    found = [(path, at, symbol, i) for path in [*range(68), None] for at in [*range(0, 100, 10), 5, 9, 1, None] for symbol in ("a", "b", "c", "", None) for i in range(1 + r.randrange(2))]
    return spark.createDataFrame(found, "path long, at long, symbol string, nth int"), spark.createDataFrame(routines, "path long, routine string, symbol string, lo int, hi int")


def _expected(found, routines):
    """By all pairs of complete ranges; paths with half ranges are left to the comparison of both ways."""
    for f in found:
        key = [r for r in routines if r.path == f.path and (not f.symbol or r.symbol == f.symbol)]
        ranges = [(r.lo, r.hi) for r in key]
        full = [(lo, hi) for lo, hi in ranges if lo is not None and hi is not None]
        wrong = len(set(ranges)) < len(ranges) or any(lo >= hi for lo, hi in full) or any(a < c < b < d for a, b in full for c, d in full)
        held = [(-r.lo, r.hi, r.routine) for r in key if not wrong and f.at is not None and r.lo is not None and r.lo <= f.at <= r.hi]
        yield (*f, min(held)[2] if held else None)


@pytest.mark.parametrize("few,many", [(128, 1_000_000), (3, 1_000_000), (128, 105), (0, 0)])
def test_associate_by_path_and_by_range(spark, monkeypatch, few, many):
    """All paths one way, some, or none: the results are the same."""
    from plumbline.operators import incremental as inc

    ways = []
    for name in ("_associate_by_path", "_associate_by_range"):
        monkeypatch.setattr(inc, name, lambda f, r, of=getattr(inc, name), name=name: ways.append((name, f.count())) or of(f, r))
    monkeypatch.setattr(inc, "FEW_ROUTINES", few)
    monkeypatch.setattr(inc, "MANY_FINDINGS", many)
    found, routines = _tables(spark)
    out = inc.associate(found, routines)
    assert out.columns == ["path", "at", "symbol", "nth", "routine"]
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    got, want = out.collect(), key(inc._associate_by_range(found, routines).collect())
    assert key(got) == want and sum(x.routine is not None for x in got) > 200
    halves = (64, 65, 66)
    assert key(x for x in got if x.path not in halves) == key(_expected([f for f in found.collect() if f.path not in halves], routines.collect()))
    by = dict(ways[:2])
    assert by["_associate_by_path"] > 0 if few else by["_associate_by_path"] == 0
    assert by["_associate_by_range"] > 0


def test_associated_routines_write_no_points(spark, monkeypatch):
    """Every place was written with its range, after five shuffles of places or ranges; now each table is shuffled once."""
    from plumbline.operators import incremental as inc
    from plumbline.plans import catalog

    written = []
    monkeypatch.setattr(inc, "cut", lambda df, *made, cut=inc.cut: written.append(out := cut(df, *made)) or out)
    out = catalog.QUERIES["associated_routines"](spark, "/root/testdata/sf0.001")
    assert out.count() > 0
    assert sum(df.count() for df in written) == 0
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 2
