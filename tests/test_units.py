"""Units from build files, range checks and paths."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import incremental as inc
from plumbline.sources import units

FILES = [
    ("go.mod", "module example.org/m\n\ngo 1.22\n"),
    ("main.go", 'package main\nimport (\n\t"fmt"\n\tx "example.org/m/a/b"\n)\n'),
    ("a/b/b.go", 'package b\nimport "example.org/m/tools"\n'),
    ("tools/go.mod", "module example.org/m/tools\n"),
    ("tools/t.go", "package tools\n"),
    ("pom.xml", "<project><artifactId>root</artifactId></project>"),
    ("core/pom.xml", "<project><parent><artifactId>root</artifactId></parent><artifactId>core</artifactId></project>"),
    ("core/src/C.java", "class C {}"),
    ("web/pom.xml", "<project><parent><artifactId>root</artifactId></parent><artifactId>web</artifactId><dependencies><dependency><groupId>g</groupId><artifactId>core</artifactId></dependency><dependency><artifactId>junit</artifactId></dependency></dependencies></project>"),
    ("web/src/W.java", "class W {}"),
    ("gr/build.gradle.kts", 'dependencies { implementation(project(":core")) }'),
    ("gr/G.java", "class G {}"),
    ("r/one/Cargo.toml", '[package]\nname = "one"\n[dependencies]\ntwo = { path = "../two" }\n'),
    ("r/one/src/lib.rs", ""),
    ("r/two/Cargo.toml", '[package]\nname = "two"\n[dependencies]\nup = { path = "../../../../x" }\n'),
    ("r/two/src/lib.rs", None),
    ("ts/app/tsconfig.json", '{ "references": [ { "path": "../lib" } ] }'),
    ("ts/app/i.ts", ""),
    ("ts/lib/tsconfig.json", "{}"),
    ("ts/lib/l.tsx", ""),
    ("loose.rs", ""),
    ("notes.txt", ""),
]


def test_plan(spark):
    owned, deps = units.plan(spark.createDataFrame(FILES, "path string, content string"))
    got = {r.path: (r.unit, r.conservative) for r in owned.collect()}
    assert got["main.go"] == ("go:/", False) and got["a/b/b.go"] == ("go:/a/b", False) and got["tools/t.go"] == ("go:/tools", False)
    assert got["core/src/C.java"] == ("java:/core", False) and got["loose.rs"] == ("rust:workspace", True) and got["ts/lib/l.tsx"] == ("typescript:/ts/lib", False)
    assert "notes.txt" not in got and len(got) == 11
    assert {tuple(r) for r in deps.collect()} == {("go:/", "go:/a/b"), ("go:/a/b", "go:/tools"), ("java:/web", "java:/core"), ("java:/gr", "java:/core"), ("rust:/r/one", "rust:/r/two"), ("typescript:/ts/app", "typescript:/ts/lib")}
    owned, deps = units.plan(spark.createDataFrame([], "path string, content string"))
    assert owned.isEmpty() and deps.isEmpty()


def test_join_path(spark):
    df = spark.createDataFrame([("a/b", "../c"), ("", "./x"), ("a", "../.."), ("a", "../../b"), ("a", "")], "b string, r string")
    assert [r[0] for r in df.select(inc.join_path(F.col("b"), F.col("r"))).collect()] == ["a/c", "x", None, None, "a"]


def test_ranges_that_cross(spark):
    r = random.Random(11)
    rows = [(k, a, a + r.randrange(0, 9)) for k in range(300) for a in [r.randrange(12) for _ in range(r.randrange(1, 4))]]
    want = set()
    for k in range(300):
        mine = [x[1:] for x in rows if x[0] == k]
        cross = any(a < c < b < d for a, b in mine for c, d in mine)
        if cross or len(set(mine)) < len(mine) or any(a >= b for a, b in mine):
            want.add(k)
    df = spark.createDataFrame(rows, "k int, lo int, hi int")
    assert {x.k for x in inc.unusable_ranges(df, "k", "lo", "hi").collect()} == want and 20 < len(want) < 280
    points = spark.createDataFrame([(1, 5), (2, 5)], "k int, at int")
    ranges = spark.createDataFrame([(1, 0, 9), (1, 4, 6), (2, 0, 6), (2, 4, 9)], "k int, lo int, hi int")
    assert [tuple(x) for x in inc.enclosing(points, ranges, "k", "at", "lo", "hi").select("k", "lo").collect()] == [(1, 4)]


def test_link_methods(spark):
    types = spark.createDataFrame([("p", "T", [1, 2]), ("p", "U", [])], "path string, type string, locations array<int>")
    fns = spark.createDataFrame([("p", 1, "f"), ("p", 3, "g")], "path string, location int, fn string")
    assert [tuple(r) for r in inc.link_methods(types, fns).collect()] == [("p", "T", 1, "f")]
    with pytest.raises(Exception, match="two routines"):
        inc.link_methods(types, fns.union(fns)).collect()
