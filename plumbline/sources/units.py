"""Units of analysis from build files: Go packages, Maven and Gradle modules, Cargo packages and
TypeScript projects, with what they depend on.

``files(path, content)`` hold sources and build files; paths are relative to the root, content is text.
All of it is expressions and joins: files are judged where they are read, and only paths, roots and
names of dependencies are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.incremental import join_path
from . import files as source

# Build files by language.
MARKERS = {"go.mod": "go", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java", "Cargo.toml": "rust", "tsconfig.json": "typescript"}


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, r"(^|/)[^/]*$", "")


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def projects(files: DataFrame) -> DataFrame:
    """(language, root, name, wants): the directory of each build file, the name that others know it by, and
    the names or directories that it asks for."""
    names = F.create_map(*[F.lit(x) for p in MARKERS.items() for x in p])
    base = F.regexp_extract("path", r"[^/]*$", 0)
    text = F.coalesce(F.col("content").cast("string"), F.lit(""))
    m = files.select(_directory(F.col("path")).alias("root"), base.alias("base"), F.try_element_at(names, base).alias("language"), text.alias("text")).where("language IS NOT NULL")
    own = F.regexp_replace(F.col("text"), r"(?s)<(parent|dependencies|dependencyManagement|build|profiles)>.*?</\1>", "")
    name = F.when(F.col("language") == "go", F.regexp_extract("text", r"(?m)^\s*module\s+(\S+)", 1)).when(F.col("base") == "pom.xml", F.regexp_extract(own, r"<artifactId>\s*([^<\s]+)", 1))
    near = lambda found: F.transform(found, lambda p: join_path(F.col("root"), p))
    wants = (
        F.when(F.col("base") == "pom.xml", _all(F.col("text"), r"(?s)<dependency>.*?<artifactId>\s*([^<\s]+)"))
        .when(F.col("base").startswith("build.gradle"), F.transform(_all(F.col("text"), r"""project\(\s*(?:path\s*[:=]\s*)?["']:([^"']+)["']"""), lambda p: F.replace(p, F.lit(":"), F.lit("/"))))
        .when(F.col("language") == "rust", near(_all(F.col("text"), r"""\bpath\s*=\s*"([^"]+)\"""")))
        .when(F.col("language") == "typescript", near(F.transform(_all(F.regexp_extract("text", r'(?s)"references"\s*:\s*\[(.*?)\]', 1), r'"path"\s*:\s*"([^"]+)"'), lambda p: F.regexp_replace(p, r"/?tsconfig\.json$", ""))))
        .otherwise(F.array().cast("array<string>"))
    )
    one = m.select("language", "root", name.alias("name"), wants.alias("wants"))
    # a directory with both kinds of build files is one project
    return one.groupBy("language", "root").agg(F.max(F.nullif("name", F.lit(""))).alias("name"), F.array_distinct(F.flatten(F.collect_list("wants"))).alias("wants"))


def owners(files: DataFrame, of: DataFrame) -> DataFrame:
    """(path, language, root, unit, conservative) of each source: its unit is that of the nearest project above it
    (a Go package is a directory of one); without any, the language's workspace, which is conservative."""
    s = files.select("path", source.language(F.col("path")).alias("language")).where("language IS NOT NULL").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    hit = s.select("path", "language", F.explode(above).alias("root")).join(of.select("language", "root"), ["language", "root"])
    nearest = hit.groupBy("path", "language").agg(F.max_by("root", F.length("root")).alias("root"))
    place = F.when(F.col("language") == "go", _directory(F.col("path"))).otherwise(F.col("root"))
    unit = F.when(F.col("root").isNull(), F.concat("language", F.lit(":workspace"))).otherwise(F.concat("language", F.lit(":/"), place))
    return s.join(nearest, ["path", "language"], "left").select("path", "language", "root", unit.alias("unit"), F.col("root").isNull().alias("conservative"))


def imports(files: DataFrame) -> DataFrame:
    """(path, name): what Go sources import."""
    text = F.col("content").cast("string")
    block = _all(F.array_join(_all(text, r"(?m)^import\s*\(([^)]*)\)"), "\n"), r'"([^"\n]+)"')
    single = _all(text, r'(?m)^import\s+(?:[\w.]+\s+)?"([^"\n]+)"')
    return files.where(F.col("path").endswith(".go")).select("path", F.explode(F.array_distinct(F.concat(block, single))).alias("name"))


def dependencies(files: DataFrame, of: DataFrame, owned: DataFrame) -> DataFrame:
    """(src, dst): units that a unit depends on, known ones and never itself."""
    units = owned.where("NOT conservative").select("language", "root", "unit").distinct()
    modules = of.where("language = 'go' AND name IS NOT NULL").select("root", "name")
    go = units.where("language = 'go'").join(modules, "root")
    below = F.expr("substring(unit, length('go:/') + if(root = '', 0, length(root) + 1) + 1)")
    known = go.select(F.concat_ws("/", "name", F.nullif(below, F.lit(""))).alias("name"), F.col("unit").alias("dst")).distinct()
    code = imports(files).join(owned.select("path", F.col("unit").alias("src")), "path").select("src", "name").distinct().join(known, "name").select("src", "dst")
    rest = units.where("language <> 'go'")
    asked = of.where("language <> 'go'").select("language", "root", F.explode("wants").alias("want")).where("want IS NOT NULL")
    called = of.where("language <> 'go'").select("language", F.explode(F.array_compact(F.array("root", "name"))).alias("want"), F.col("root").alias("to")).distinct()
    at = asked.join(called, ["language", "want"]).select("language", "root", "to").distinct()
    src = at.join(rest.withColumnRenamed("unit", "src"), ["language", "root"])
    built = src.join(rest.select("language", F.col("root").alias("to"), F.col("unit").alias("dst")), ["language", "to"]).select("src", "dst")
    return code.union(built).where("src <> dst").distinct()


def plan(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Owners of the sources, and the dependencies of the units."""
    of = projects(files)
    owned = owners(files, of)
    return owned, dependencies(files, of, owned)
