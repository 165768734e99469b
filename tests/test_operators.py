import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import depth, metrics, scoring
from plumbline.sources import files, protocol
from plumbline.streaming import changes


def test_source_files(spark):
    paths = ["a/b.go", "a/b_test.go", "A/Vendor/x.go", "src/main/resources/T.java", "src/main/T.java", "x/y.d.ts", "x/y.spec.tsx", "z.MTS", "n.py", "dist", "tests/a.go", "src/__tests__/x.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {(r.path, r.language) for r in files.source_files(df).collect()} == {("a/b.go", "go"), ("src/main/T.java", "java"), ("z.MTS", "typescript")}
    assert {r.path for r in files.source_files(df, tests=True).collect()} >= {"a/b_test.go", "x/y.spec.tsx", "tests/a.go", "src/__tests__/x.ts"}
    assert files.missing_languages(files.source_files(df), ["go", "rust"]) == ["rust"]


def test_protocol(spark, tmp_path):
    base = {"protocol_version": 1, "invocation_id": "i"}
    rows = [{"type": "measurement", "path": "a", "component_id": "c", "value": v, **base} for v in (3, 2.5, "7", {"$integer": "9007199254740993"}, "x")]
    rows += [{"type": "coverage", "path": "a", "component_id": "c", "state": "complete", **base}, {"type": "terminal", "status": "ok", **base}]
    p = tmp_path / "a.ndjson"
    p.write_text("\n".join(map(json.dumps, rows)))
    got = protocol.read(spark, str(p), "i")
    assert [r.number for r in got["measurement"].collect()] == [3, 2.5, 7, 9007199254740992.0, None]
    assert got["coverage"].first().state == "complete"
    with pytest.raises(ValueError, match="invocation"):
        protocol.read(spark, str(p), "j")
    p.write_text("\n".join(map(json.dumps, rows[:-1])))
    with pytest.raises(ValueError, match="terminal"):
        protocol.read(spark, str(p))


def test_depth(spark):
    rows = [("identity", (1, 1, 1, 0, 0, 0, 0), [[]], {}), ("constant", (1, 1, 0, 0, 0, 0, 0), [[]], {}), ("increment", (1, 1, 1, 0, 0, 0, 0), [["x"]], {"x": "X"}), ("choice", (1, 1, 1, 0, 0, 0, 0), [["x", "v"], ["v"]], {"x": "X", "v": "V"})]
    df = spark.createDataFrame(rows, "id string, b struct<O:long,T:long,A:long,E:long,P:long,S:long,L:long>, alternatives array<array<string>>, categories map<string,string>")
    df = df.select("id", depth.burden(F.col("b")).alias("b8"), depth.hidden(F.col("alternatives"), F.col("categories")).alias("h"))
    got = {r.id: (r.b8, r.h, r.s) for r in df.withColumn("s", depth.shallow(F.col("b8"), F.col("h"))).collect()}
    assert got == {"identity": (14, 0, 100), "constant": (12, 0, 100), "increment": (14, 2, 30), "choice": (14, 1, 47)}
    fam = spark.createDataFrame([([[["a"], ["b"]], [["c"], ["a"]]],), ([[[str(i)] for i in range(9)]] * 2,)], "f array<array<array<string>>>")
    got = [r[0] for r in fam.select(depth.cross(F.col("f"))).collect()]
    assert sorted(got[0]) == [["a"], ["a", "b"], ["a", "c"], ["b", "c"]] and got[1] is None


def test_metrics(spark):
    nodes = spark.createDataFrame([("p", "f", 1, "if", 1, None, 1), ("p", "f", 2, "return", 0, None, 1), ("p", "f", 3, "return", 0, None, 0), ("p", "g", 1, "case", 0, True, 0), ("p", "g", 2, "case", 0, False, 0), ("p", "g", 3, "if", 0, None, 3), ("p", "h", 1, "panic", 1, None, 0), ("p", "h", 2, "case", 2, False, 0)], "path string, fn string, node_id int, kind string, operators int, is_default boolean, if_depth int")
    assert {r.fn: r.cyclomatic for r in metrics.cyclomatic(nodes).collect()} == {"f": 3, "g": 3, "h": 5}
    assert [tuple(r) for r in metrics.deeply_nested(nodes).collect()] == [("p", "g", 3)]
    names = spark.createDataFrame([("Service", "Run"), ("Service", "Service"), (None, "main")], "r string, n string")
    assert [r[0] for r in names.select(metrics.routine_name(F.col("r"), F.col("n"))).collect()] == ["Service.Run", "Service.<init>", "main"]
    m = spark.createDataFrame([("T", "a", ["x"]), ("T", "b", ["x", "y"]), ("T", "c", []), ("U", "a", ["x"])], "type string, method string, fields array<string>")
    assert {r.type: r.tcc for r in metrics.tcc(m).collect()} == {"T": pytest.approx(1 / 3), "U": 0.0}


def test_changes(spark, tmp_path):
    rows = [("u", "a", "2024-01-01 00:00:00.00", 1), ("u", "b", "2024-01-01 00:00:00.05", 2), ("u", "a", "2024-01-01 00:00:00.12", 4), ("u", "c", "2024-01-01 00:00:09", 1)]
    df = spark.createDataFrame(rows, "unit string, path string, t string, op int").withColumn("ts", F.to_timestamp("t")).drop("t")
    assert [r.paths for r in changes.bursts(df).orderBy("began").collect()] == [["a", "b"], ["c"]]
    df.write.parquet(str(tmp_path / "in"))
    q = changes.coalesce(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("coalesced").start()
    try:
        q.processAllAvailable()
        assert {(r.path, r.op) for r in spark.table("coalesced").collect()} == {("a", 5), ("b", 2), ("c", 1)}
    finally:
        q.stop()


def test_depth_faults_and_files(spark):
    good = {"x": "X"}
    rows = [("a", (1, 1, 1, 0, 0, 0, 0), ["f"], [["x"]], good), (" ", (1, 1, -1, 0, 0, 0, 0), ["f", "f"], [], {}), ("c", (0, 0, 0, 0, 0, 0, 0), ["f"], [["y"]], {"x": "Q"})]
    df = spark.createDataFrame(rows, "boundary string, b struct<O:long,T:long,A:long,E:long,P:long,S:long,L:long>, families array<string>, alternatives array<array<string>>, categories map<string,string>")
    assert {tuple(r) for r in depth.faults(df).collect()} == {(" ", "identity"), (" ", "negative_burden"), (" ", "repeated_family"), (" ", "no_alternative"), ("c", "unknown_obligation"), ("c", "unknown_category")}
    b = spark.createDataFrame([("a", ["p", "q"], "measured", 40), ("b", ["p"], "partial", None), ("c", ["r"], "not_applicable", 9), ("d", ["s", "p"], "unavailable", 90), ("e", ["t"], "estimated", 7), ("f", ["u"], "measured", None), ("g", ["v"], "measured", 5)], "boundary string, files array<string>, state string, value long")
    contracts = spark.createDataFrame([("v",), ("w",)], "path string")
    assert {r.path: (r.state, r.value) for r in depth.per_file(b, contracts).collect()} == {"p": ("unavailable", 40), "q": ("measured", 40), "r": ("not_applicable", None), "s": ("unavailable", None), "t": ("partial", 7), "u": ("unavailable", None), "v": ("measured", 0), "w": ("measured", 0)}
    m = spark.createDataFrame([("a", "measured", 1, ""), ("a", "partial", 9, "x"), ("b", "measured", None, ""), ("c", "measured", 1, "x"), ("c", "measured", 1, "y"), ("d", "not_applicable", 3, None), ("e", "measured", 1, None), ("e", "measured", 2, None)], "boundary string, state string, score long, fingerprint string")
    assert {r.boundary: (r.state, r.score) for r in scoring.merge_boundaries(m).collect()} == {"a": ("partial", 1), "b": ("measured", None), "c": ("unavailable", None), "d": ("not_applicable", None), "e": ("unavailable", None)}
    inv = spark.createDataFrame([(["b", "a", "a"], ["o"], []), (["a", "b"], ["o"], []), (["a"], ["o"], [])], "f array<string>, o array<string>, c array<string>")
    h = [r[0] for r in inv.select(depth.inventory_fingerprint(F.col("f"), F.col("o"), F.col("c"))).collect()]
    assert h[0] == h[1] != h[2]
