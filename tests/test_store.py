"""Stored results: keys, generations, and what is still good; registries; the change log."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import findings, registry, score_files, store, views
from plumbline.sources import files
from plumbline.streaming import changes


def test_unit_keys_depend_on_inputs_alone(spark):
    units = spark.createDataFrame([("u", "go"), ("v", "go")], "unit string, language string")
    one = lambda rows: spark.createDataFrame(rows, "unit string, path string, digest string")
    deps = spark.createDataFrame([("u", "v", "f")], "unit string, dependency string, fingerprint string")
    key = lambda s, c={"cog": "1"}, d=deps, o={"tests": False}: {r.unit: r.key for r in store.unit_keys(units, one(s), one([]), d, c, o).collect()}  # noqa: E731, B006
    base = key([("u", "a", "1"), ("u", "b", "2")])
    assert base == key([("u", "./b", "2"), ("u", "a", "1"), ("u", "a", "1")]) and base["u"] != base["v"]
    for other in (key([("u", "a", "1")]), key([("u", "a", "12"), ("u", "b", "")]), key([("u", "a", "1"), ("u", "b", "2")], {"cog": "2"}), key([("u", "a", "1"), ("u", "b", "2")], d=deps.limit(0)), key([("u", "a", "1"), ("u", "b", "2")], o={"tests": True})):
        assert other["u"] != base["u"]
    assert store.view_key("/w/", ["b", "a/"], ["go", "go"]) == store.view_key("/w", ["a", "b"], ["go"]) != store.view_key("/w", ["a"], ["go"])


def test_generations(spark, tmp_path):
    g = store.Generations(spark, f"file://{tmp_path}", "view")
    assert g.current() is None and g.prune() == []
    with pytest.raises(LookupError):
        g.load("t")
    assert g.commit({"t": spark.range(3), "s": spark.range(1)}) == 1 and g.load("t").count() == 3

    def fails():
        raise RuntimeError("changed")

    with pytest.raises(RuntimeError, match="changed"):
        g.commit({"t": spark.range(9)}, verify=fails)
    assert g.current() == 1 and g.load("t").count() == 3
    assert g.commit({"t": spark.range(5).repartition(4), "s": spark.range(1)}) == 2 and g.load("t").count() == 5 and g.load("t", 1).count() == 3
    before, after = g.compact("t")
    assert before > after == 1 and g.current() == 3 and g.load("t").count() == 5
    # another writer publishes the next number first
    with pytest.raises(RuntimeError, match="another writer"):
        g.commit({"t": spark.range(1)}, verify=lambda: g._fs(f"{g.folder}/current/4")[0].create(g._fs(f"{g.folder}/current/4")[1], False).close())
    assert g.prune(keep=2) == [1, 2] and g.current() == 4


def test_inputs_must_not_change(spark):
    stamps = lambda *rows: spark.createDataFrame(rows, "path string, size long, mtime long")
    store.unchanged(stamps(("a", 1, 1)), stamps(("a", 1, 1)))()
    with pytest.raises(RuntimeError, match="a"):
        store.unchanged(stamps(("a", 1, 1)), stamps(("a", 2, 1)))()


def test_startup_and_retries(spark):
    rows = lambda *r: spark.createDataFrame(r, "unit string, language string, key string")
    planned = rows(("u", "go", "k"), ("v", "go", "l"))
    assert store.all_stored(planned, rows(("u", "go", "k"), ("v", "go", "l"), ("w", "go", "m")))
    assert not store.all_stored(planned, rows(("u", "go", "k"), ("v", "rust", "l")))
    left = store.retry_units(planned, spark.createDataFrame([("u", True), ("v", False)], "unit string, transient boolean"))
    assert [r.unit for r in left.collect()] == ["v"]
    b = spark.createDataFrame([("x", ["p", "q", "r"])], "boundary string, files array<string>")
    owners = spark.createDataFrame([("p", "u"), ("q", "u"), ("r", "v")], "path string, unit string")
    assert {(r.unit, tuple(r.files)) for r in store.boundaries_by_owner(b, owners).collect()} == {("u", ("p", "q")), ("v", ("r",))}


def test_content_digest(spark):
    d = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "a int, b string")
    assert store.content_digest(d) == store.content_digest(d.repartition(3).select("b", "a"))
    assert len({store.content_digest(x) for x in (d, d.distinct(), d.na.fill(""), d.limit(0))}) == 4
    assert store.compact(d.withColumn("evidence", F.lit(1))).columns == ["a", "b"]


def test_registry(spark):
    m = registry.Metrics()

    @m.add("cog", "v1")
    def cog(facts):
        return facts["functions"].selectExpr("path", "line", "1 AS column", "name AS subject", "10 AS value")

    @m.add("npath", "v2")
    def npath(facts):
        raise AssertionError("not requested")

    with pytest.raises(ValueError, match="already"):
        m.add("cog", "v2")
    facts = {"functions": spark.createDataFrame([("b", 1, "f"), ("a", 9, "g"), ("a", 2, "h")], "path string, line int, name string")}
    got = m.analyze(facts, ["cog"])
    assert [(r.path, r.line, r.component, r.definition, r.value) for r in got.collect()] == [("a", 2, "cog", "v1", 10.0), ("a", 9, "cog", "v1", 10.0), ("b", 1, "cog", "v1", 10.0)]
    for wrong in ([], ["other"]):
        with pytest.raises(ValueError):
            m.analyze(facts, wrong)
    r = registry.Readers()
    r.add("go", lambda f: f.selectExpr("path", "length(content) AS n"))
    src = spark.createDataFrame([("a.go", "xx", "go"), ("b.rs", "x", "rust")], "path string, content string, language string")
    assert [tuple(x) for x in r.read(src, ["go"]).collect()] == [("a.go", 2)]
    with pytest.raises(ValueError, match="rust"):
        r.read(src, ["go", "rust"])


def test_policy_and_profile(spark):
    names = [c[0] for c in score_files.COMPONENTS]
    got = {r.component: (r.weight, r.enabled) for r in registry.policy(spark, {"god_class": {"weight": 0}, "npath_complexity": {"enabled": False}}, names).collect()}
    assert got == {"god_class": (0.0, None), "npath_complexity": (None, False)}
    for wrong in ({"x": {}}, {"god_class": {"weight": -1}}, {"god_class": {"weight": float("nan")}}, {"god_class": {"color": 1}}):
        with pytest.raises(ValueError):
            registry.policy(spark, wrong, names)
    profile = {k: 1.0 for k in registry.PROFILE}
    assert registry.profile_identity(profile) == registry.profile_identity(dict(reversed(profile.items()))) != registry.profile_identity({**profile, "free": 2})
    for wrong in ({}, {**profile, "free": 0}, {**profile, "free": True}, {**profile, "more": 1}):
        with pytest.raises(ValueError):
            registry.profile_identity(wrong)


def test_scores_of_few_files(spark):
    """By hand: grouping, residual, coverage, a policy, and files without anything."""
    f = spark.createDataFrame([("a", "go"), ("b", "go"), ("c", "cobol")], "path string, language string")
    cat = score_files.catalog(spark).where(F.col("component").isin("cognitive_complexity", "cyclomatic_method_complexity", "cyclomatic_class_complexity"))
    obs = [("a", "cognitive_complexity", "r1", "", "", 15.0), ("a", "cyclomatic_method_complexity", "r1", "", "T", 10.0), ("a", "cyclomatic_method_complexity", "r2", "", "T", 10.0), ("a", "cyclomatic_class_complexity", "T", "", "", 640.0), ("b", "cognitive_complexity", "r", "", "", 15.0)]
    o = spark.createDataFrame([(*x, None, None, None) for x in obs], "path string, component string, subject string, routine string, owner string, value double, wmc double, atfd double, tcc double")
    cov = spark.createDataFrame([(p, c, "failed" if p == "b" and c == "cyclomatic_method_complexity" else "complete") for p in "ab" for c in ("cognitive_complexity", "cyclomatic_method_complexity", "cyclomatic_class_complexity")], "path string, component string, state string")
    s = score_files.score(f, o, cov, cat, most=20)
    # r1: cognitive 10 against 5; r2: 5; the type 20 less the 15 of its routines
    assert {(r.path, r.component): (r.observed, r.contribution) for r in s.components.where("path = 'a'").collect()} == {("a", "cognitive_complexity"): (10.0, 10.0), ("a", "cyclomatic_method_complexity"): (10.0, 5.0), ("a", "cyclomatic_class_complexity"): (20.0, 5.0)}
    assert {r.path: (r.score, r.observed_score, r.complete, r.passed, r.available) for r in s.files.collect()} == {"a": (20.0, 40.0, True, True, True), "b": (10.0, 10.0, False, False, True), "c": (0.0, 0.0, True, True, False)}
    p = registry.policy(spark, {"cognitive_complexity": {"weight": 0}}, ["cognitive_complexity"])
    assert {r.path: r.score for r in score_files.score(f, o, cov, cat, p).files.collect()} == {"a": 20.0, "b": 0.0, "c": 0.0}


def test_targets_and_languages(spark, tmp_path):
    assert files.targets("/w", ["a", "/w/b/../c", "a/"]) == ["/w/a", "/w/c"] and files.targets("/w", ["."]) == ["/w"]
    for wrong in ("../x", "/wx/a", "a/../../w2"):
        with pytest.raises(ValueError, match="outside"):
            files.targets("/w", [wrong])
    for p in ("a/x.go", "a/tests/y.go", "b/src/__tests__/z.ts", "b/w.rs"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = lambda **k: {r.path for r in files.scan(spark, str(tmp_path), **k).collect()}
    assert got() == {"a/x.go", "b/w.rs"} and got(tests=True) == {"a/x.go", "a/tests/y.go", "b/src/__tests__/z.ts", "b/w.rs"}
    assert got(wanted=["a", "a/x.go"]) == {"a/x.go"}
    all_ = files.scan(spark, str(tmp_path))
    assert files.require_languages(all_, ["rust"]).count() == 1 and files.require_languages(all_, []).count() == 2
    with pytest.raises(ValueError, match="java"):
        files.require_languages(all_, ["go", "java"])
    assert {tuple(r) for r in files.by_language(all_).collect()} == {("go", 1), ("rust", 1)}


def test_changes_by_scope(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [("w/a/b.go", 1, False), ("w/go.mod", 2, False), ("w/lib/x/y.go", 1, False), ("other/z", 1, False), (None, 0, True)]
    (log / "1.json").write_text("\n".join(json.dumps({"path": p, "op": o, "ts": "2024-01-01T00:00:00Z", "all": a}) for p, o, a in rows))
    c = spark.read.schema(changes.SCHEMA).json(str(log))
    scopes = spark.createDataFrame([("w", False, "config"), ("w/a", True, "source"), ("w/lib", True, "dependency"), ("w/lib/x", True, "source")], "scope string, recursive boolean, kind string")
    assert {(r.path, r.kind) for r in changes.classify(c, scopes).collect()} == {("w/a/b.go", "source"), ("w/go.mod", "config"), ("w/lib/x/y.go", "source")}
    assert changes.losses(c).first().losses == 1
    seen = []
    q = changes.start(changes.source(spark, str(log)), lambda batch, n: seen.append(batch.count()), str(tmp_path / "cp"), "0 seconds")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sum(seen) == 5


def test_cells_and_durations(spark):
    d = spark.createDataFrame([("1h30m",), ("250ms",), ("1.5s",), ("10",), ("",), ("5m x",)], "t string")
    assert [r[0] for r in d.select(views.seconds(F.col("t"))).collect()] == [5400.0, 0.25, 1.5, None, None, None]
    with pytest.raises(ValueError):
        views.jobs(d, order="other")
    c = spark.createDataFrame([(1.0, True, False), (None, True, False), (1.0, False, False), (1.0, True, True)], "v double, a boolean, f boolean")
    assert [r[0] for r in c.select(views.cell(F.col("v"), F.col("a"), F.col("f"))).collect()] == ["1.0", "-", "-", "X"]
    s = spark.createDataFrame([(["a", "b"], ["a"], True, False), (["a"], [], True, False), (["b", "c", "a"], [], True, False), (["a", "b"], [], False, False), (["a", "b"], [], True, True)], "e array<string>, p array<string>, k boolean, d boolean")
    assert [r[0] for r in s.select(findings.missing_cases(*[F.col(x) for x in "epkd"])).collect()] == [["b"], None, ["a", "b", "c"], None, None]


def test_overlay(spark):
    t = lambda *rows: spark.createDataFrame(rows, "unit string, path string")
    plan = {"units": t(("u", "1"), ("v", "1"), ("w", "1")), "sources": t(("u", "a"), ("v", "b"), ("w", "c"))}
    out = store.overlay(plan, {"units": t(("u", "2")), "sources": t(("x", "d"))}, spark.createDataFrame([("w",)], "unit string"))
    assert {k: sorted(map(tuple, d.collect())) for k, d in out.items()} == {"units": [("u", "2"), ("v", "1")], "sources": [("v", "b"), ("x", "d")]}


def test_an_analyzer_of_its_own(spark):
    import sys

    from plumbline.sources import process

    script = """
import json, sys
rows = [json.loads(x) for x in sys.stdin]
if any("crash" in r["content"] for r in rows): sys.exit(3)
for r in rows:
    base = {"protocol_version": 1, "invocation_id": r["invocation_id"], "path": r["path"], "component_id": "lines"}
    print(json.dumps({"type": "measurement", "value": len(r["content"]), **base}))
    print(json.dumps({"type": "coverage", "state": "complete", **base}))
if not any("open" in r["content"] for r in rows): print(json.dumps({"type": "terminal"}))
"""
    files = spark.createDataFrame([("a", "xyz"), ("b", "crash"), ("c", None), ("d", "open")], "path string, content string")
    got = process.tables(process.analyze(files, [sys.executable, "-c", script], "i", each=1))
    assert {r.path: r.number for r in got["measurement"].collect()} == {"a": 3.0, "c": 0.0}
    assert {r.path: (r.state, r.reason) for r in got["coverage"].collect()} == {"a": ("complete", None), "b": ("failed", "CalledProcessError"), "c": ("complete", None), "d": ("failed", "ValueError")}
    missing = process.analyze(files, ["/no/such/program"], "i")
    assert missing.where("failure IS NOT NULL").count() == 4


def test_subjects(spark):
    from plumbline.functions import keys

    d = spark.createDataFrame([("s", "n", 1), ("", "n", 2), (None, None, 3)], "s string, n string, l int")
    c = lambda x: F.lit(x)
    assert [r[0] for r in d.select(keys.subject(F.col("s"), F.col("n"), F.col("l"), c(1), c(9), c(2))).collect()] == ["s@1:1-9:2", "n@2:1-9:2", "3:1-9:2"]
    assert d.select(keys.identity(F.col("s"), F.col("n"))).distinct().count() == 3
