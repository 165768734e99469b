"""Cases of the third review: queries over tables that the smallest ones don't show."""

import duckdb
import pytest
from test_catalog import rows

from plumbline.plans import catalog


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query gives what its SQL gives, over tables that SQL makes."""

    def check(name, **tables):
        c = duckdb.connect()
        for t, sql in tables.items():
            c.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            c.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        got, want = catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), c.execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return check


def test_pages_whose_names_end_in_a_slash(same):
    urls = ["http://a.org/de/2137/", "http://a.org/de/2137", "http://a.org/de/21/", "http://a.org/de/", "http://a.org/de/27/x", "http://a.org/en/7/", "http://blog.a.org/de/7", "http://a.org/de/7.html", "http://a.org/x.html"]
    same("ignored_paths", pages=" UNION ALL ".join(f"SELECT {i}::BIGINT AS page_id, '{u}' AS url" for i, u in enumerate(urls)))


def test_events_at_one_place(same):
    """Two lines of one part: the first of the table decides, whichever it is."""
    line = "SELECT {0}::BIGINT AS l_orderkey, {1}::INTEGER AS l_linenumber, 3::BIGINT AS l_partkey, 2::BIGINT AS l_suppkey, {2}::DOUBLE AS l_quantity"
    same("released_resources", lineitem=" UNION ALL ".join(line.format(k, n, q) for k in range(40) for n, q in ((1, 30), (2, 10 if k % 2 else 40), (2, 40 if k % 2 else 10))))


def test_scores_write_nothing(spark, monkeypatch):
    """Subjects and coverage were two written tables."""
    from plumbline import scratch

    monkeypatch.setattr(scratch, "cut", None)
    monkeypatch.setattr("plumbline.operators.score_files.cut", None, raising=False)
    assert catalog.QUERIES["score_summary"](spark, "/root/testdata/sf0.001").count() == 1


def test_kinds_are_those_of_the_tokens(spark):
    from collections import Counter

    from plumbline.sources import lexer

    texts = [b"a = 'x' + \"y\" // c\n b 12.5 'life 'q' `z` /* k */ >= \xe9t", b"a /* open", b"", None, b"x " * 50, b"'\\"]
    got = {r.path: r for r in lexer.kinds(spark.createDataFrame(list(enumerate(texts)), "path long, content binary"), most=30).collect()}
    for i, text in enumerate(texts):
        want = Counter(t[0] for t in lexer.lex(text or b"", 30)[0])
        assert [got[i][k] for k in lexer.KINDS] == [want[k] for k in lexer.KINDS]


@pytest.mark.parametrize("rows,nested", [(1_000_000, False), (1_000_000, True), (20, False)])
def test_innermost_by_walk_and_by_blocks(spark, monkeypatch, rows, nested):
    """Against all pairs; a walk finds what blocks find, and few points are left to the blocks."""
    import random

    from plumbline.operators import incremental as inc

    monkeypatch.setattr(inc, "WALK_ROWS", rows)
    left, by_blocks = [], inc._by_blocks
    monkeypatch.setattr(inc, "_by_blocks", lambda points, *rest: left.append(points.count()) or by_blocks(points, *rest))
    r = random.Random(1)
    if nested:
        ranges = [(k, 100 - 10 * n - k, 100 + 10 * n, f"{k}.{n}") for k in range(5) for n in range(1, 8) if r.random() < 0.7]
    else:
        ranges = [(r.randrange(3), lo := r.randrange(60), lo + r.randrange(-1, 12), f"n{i}") for i in range(80)]
    points = [(k, p, i % 2) for k in range(5) for p in range(200) for i in range(2)]
    a, b = spark.createDataFrame(points, "k long, p long, copy int"), spark.createDataFrame(ranges, "k long, lo long, hi long, name string")
    got = sorted(tuple(x) for x in inc.innermost(a, b, "k", "p", "lo", "hi", nested).select("k", "p", "copy", "lo", "hi", "name").collect())
    want = []
    for k, p, i in points:
        held = [(-lo, hi, name) for kk, lo, hi, name in ranges if kk == k and lo <= p <= hi]
        if held:
            lo, hi, name = min(held)
            want.append((k, p, i, -lo, hi, name))
    assert got == sorted(want) and want
    # none of nested ranges, some of ranges that cross, all of keys that are too large
    assert not left if nested else left[0] == len(points) if rows == 20 else 0 < left[0] < len(points)


def test_burdens_at_the_end_of_64_bits(spark):
    """Without a row that fails on the way: the plan has no multiplication or sum that is tried."""
    from pyspark.sql import functions as F

    from plumbline.operators import depth

    names, weights = list(depth.BURDEN_WEIGHTS), list(depth.BURDEN_WEIGHTS.values())
    most = 2**63 - 1
    cases = [[most // weights[0], 0, 0, 0, 0, 0, 0], [most // weights[0], 1, 1, 1, 1, 1, 1], [most] * 7, [0] * 7, [-1, 0, 0, 0, 0, 0, 0], [None, 0, 0, 0, 0, 0, 0], [2**32 - 1] * 7, [2**40 + 5] * 7]
    df = spark.createDataFrame(cases, ", ".join(f"{n} long" for n in names)).select(depth.burden(F.struct(*names)).alias("b"))
    total = [None if None in c or min(c) < 0 else sum(x * w for x, w in zip(c, weights)) for c in cases]
    assert [r.b for r in df.collect()] == [t if t is not None and t <= most else None for t in total]
    assert "try_" not in df._jdf.queryExecution().analyzed().toString()


def test_no_duration_is_minus_zero(spark):
    from plumbline.operators import views

    df = spark.createDataFrame([("-0m",), ("-0",), ("-1m",)], "t string")
    assert [str(r.s) for r in df.select(views.seconds(df.t).alias("s")).collect()] == ["0.0", "0.0", "-60.0"]
