"""Ignore files against git, and the report sinks."""

import random
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from plumbline.sources import ignore, report


def git_ignored(root, rules, paths):
    for base, text in rules.items():
        d = root / base
        d.mkdir(parents=True, exist_ok=True)
        (d / ".gitignore").write_text(text)
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    out = subprocess.run(["git", "-C", str(root), "check-ignore", "--stdin", "--no-index"], input="\n".join(paths), capture_output=True, text=True)
    return set(out.stdout.split("\n")) - {""}


@pytest.mark.skipif(not shutil.which("git"), reason="needs git")
def test_ignore_rules_as_git_reads_them(spark, tmp_path):
    rules = {
        "": "# all\n*.log\n!keep.log\n/top\nbuild/\na/**/z\n**/deep/*.tmp\nq?.txt\n[!a-c]x.md\n\\!bang\n\\#hash\nblank\\ \ntrail   \n[[:digit:]]n\nopen[\nout/**\n!out/in\n",
        "src": "!*.log\n/gen\ngen2/\n*.go\n!main.go\n",
        "src/lib": "*\n!keep\n",
        "build": "!*\n",
    }
    r = random.Random(5)
    names = ["a", "b.log", "keep.log", "top", "build", "z", "deep", "x.tmp", "q1.txt", "dx.md", "ax.md", "!bang", "#hash", "5n", "open[", "gen", "gen2", "main.go", "w.go", "lib", "keep", "src", "out", "in", "trail", "blank "]
    paths = sorted({"/".join(r.choice(["src", "src/lib", "build", "a", *names]) for _ in range(r.randrange(3))) + "/" + r.choice(names) for _ in range(900)})
    paths = [p for p in (p.removeprefix("/") for p in paths) if not p.endswith(" ") and p not in rules]
    want = git_ignored(tmp_path, rules, paths)
    table = ignore.rules(spark.createDataFrame([(f"{b}/.gitignore".removeprefix("/"), t) for b, t in rules.items()], "path string, content string"))
    got = {x.path for x in ignore.kept(spark.createDataFrame([(p, 1) for p in paths], "path string, size int"), table).collect()}
    assert set(paths) - got == want and len(want) > 100


def test_ignore_edges(spark):
    files = spark.createDataFrame([("a/b.x", 1), ("a/b.x", 2), (None, 3), ("c", 4)], "path string, n int")
    none = spark.createDataFrame([], "path string, content string")
    assert ignore.kept(files, ignore.rules(none)).count() == 4
    table = ignore.rules(spark.createDataFrame([(".gitignore", "*.x")], "path string, content string"), project="!b.x\nc")
    assert sorted(r.n for r in ignore.kept(files, table).collect()) == [1, 2, 3]
    one = spark.createDataFrame([("a/.gitignore", "x")], "path string, content string")
    two = spark.createDataFrame([("a/.gitignore", "y")], "path string, content string")
    assert len({ignore.fingerprint(d).first()[0] for d in (none, one, two, one)}) == 3


ROWS = [
    (1, "src/a.go", 12.345678, True, True, {"cognitive_complexity": (3.0, 7.0, 2), "god_class": (1.5, 1.0, 1), "cyclomatic_method_complexity": (1.0, 4.0, 3)}, {"npath_complexity": "failed"}, ("measured", True, 40.0)),
    (2, "b.go", 3.0, True, False, {}, {}, None),
    (10, "long/path/c.go", 1.0, False, None, {"cyclomatic_class_complexity": (1.0, -2.0, 1)}, {"cyclomatic_class_complexity": "unavailable"}, ("not_applicable", False, None)),
]


def test_table(spark):
    df = spark.createDataFrame(ROWS, report.FILES_SCHEMA)
    lines = [r.line for r in report.table(df, gated=True).orderBy("at").collect()]
    assert lines == [
        "PASS  RANK    SCORE  COG MAX/#  NPATH MAX/#  CYCLO TOT/MAX  SHALLOW  GOD  PATH",
        " yes     1  12.3457        7/2            X            -/4       40  1.5  src/a.go",
        "  NO     2        3          -            -              -        -    -  b.go",
        "  NO    10        X          -            -            X/-      N/A    -  long/path/c.go",
    ]
    assert [r.line for r in report.table(df.limit(0), compact=True).collect()] == ["SCORE  PATH"]


def test_diagnostics_limit_json_exit(spark, tmp_path):
    d = spark.createDataFrame([("error", "E1", "a.go", "bad"), ("warning", "W", "a.go", "a.go:3 odd"), ("info", "I", None, "x"), ("error", None, None, "no path"), ("error", "E", "b", "")], "severity string, code string, path string, message string")
    assert [r.line for r in report.diagnostics(d).collect()] == ["error E1: a.go: bad", "warning W: a.go:3 odd", "error : no path"]
    df = spark.createDataFrame(ROWS, report.FILES_SCHEMA)
    rows, cut = report.limited(df, 2)
    assert rows.count() == 2 and cut and report.limited(df, 0)[1] is False and report.limited(df, 10)[1] is False
    assert (report.exit_code(df), report.exit_code(df, True), report.exit_code(df.where("rank = 1"), True), report.exit_code(None)) == (0, 3, 0, 2)
    report.write_json(df, str(tmp_path / "out"))
    back = spark.read.schema(report.FILES_SCHEMA).json(str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert back.agg(F.max("rank")).first()[0] == 10
