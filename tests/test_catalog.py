"""Each query against its SQL over the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from plumbline.plans import catalog

SF = "/root/testdata/sf0.001"


def rows(df):
    out = []
    for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None):
        row = []
        for v in r:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                row.append(None)
            elif hasattr(v, "isoformat"):
                row.append(str(pd.Timestamp(v)))
            elif isinstance(v, bool | str):
                row.append(v)
            else:
                row.append(round(float(v), 6))
        out.append(repr(row))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_token_kinds(spark, duck):
    """No SQL has the lexer's rules: against the lexer alone, page by page."""
    from collections import Counter

    from plumbline.sources import lexer

    got = {r.path: r for r in catalog.QUERIES["token_kinds"](spark, SF).collect()}
    for page, html in duck.execute("SELECT page_id, html FROM pages").fetchall():
        want = Counter(t[0] for t in lexer.lex((html or "").encode(), None)[0])
        row = got.pop(str(page), None)
        assert (row is None and not want) or all(row[k] == want[k] for k in ("identifier", "number", "string", "operator", "lifetime"))
    assert not got
