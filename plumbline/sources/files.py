"""Selection of source files, as predicates on a path column."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by extension, and directories that hold no sources.
LANGUAGES = {".go": "go", ".java": "java", ".rs": "rust", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript"}
IGNORED_DIRECTORIES = (
    ".git", ".gradle", ".idea", ".mypy_cache", ".pytest_cache", ".ruff_cache",
    "build", "coverage", "dist", "node_modules", "out", "target", "vendor",
)
TEST_DIRECTORIES = (
    "__tests__", "integration-test", "integration-tests", "integrationtest", "integrationtests",
    "spec", "specs", "test", "test-fixtures", "testfixtures", "tests",
)


def _normal(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def language(path: Column) -> Column:
    """Language by extension, null for anything else."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(names, F.regexp_extract(_normal(path), r"\.[^./]+$", 0))


def is_test(path: Column) -> Column:
    return _normal(path).rlike(r"_test\.go$|\.(spec|test)\.(ts|tsx|mts|cts)$")


def is_declaration(path: Column) -> Column:
    return _normal(path).rlike(r"\.d\.(ts|mts|cts)$")


def is_ignored(path: Column, tests: bool = False) -> Column:
    """Whether a directory of the path is ignored or, unless ``tests``, one of tests, or it is a Java
    resource."""
    parts = F.split(_normal(path), "/")
    directories = F.slice(parts, F.lit(1), F.size(parts) - 1)
    resource = _normal(path).endswith(".java") & _normal(path).rlike(r"(^|/)src/[^/]+/resources/")
    names = IGNORED_DIRECTORIES if tests else IGNORED_DIRECTORIES + TEST_DIRECTORIES
    return F.arrays_overlap(directories, F.array(*[F.lit(x) for x in names])) | resource


def source_files(files: DataFrame, tests: bool = False) -> DataFrame:
    """``files(path, ...)`` that are sources, with their ``language``."""
    out = files.withColumn("language", language(F.col("path"))).where(F.col("language").isNotNull() & ~is_ignored(F.col("path"), tests) & ~is_declaration(F.col("path")))
    return out if tests else out.where(~is_test(F.col("path")))


def targets(root: str, wanted: list[str]) -> list[str]:
    """Paths of ``wanted`` (files or directories, absolute or from ``root``), each once; one that lies
    outside of ``root`` is an error."""
    base, out = posixpath.normpath(root), []
    for target in wanted:
        path = posixpath.normpath(posixpath.join(base, target))
        if path != base and not path.startswith(base.rstrip("/") + "/"):
            raise ValueError(f"target {target!r} is outside of {root!r}")
        out.append(path)
    return list(dict.fromkeys(out))


def _underscored(spark: SparkSession, places: list[str]) -> list[str]:
    """Directories below ``places`` whose names start with an underscore: Spark's file source passes them over unless it
    is given them.  A walk over directories on the driver, no files are opened."""
    out, todo = [], list(places)
    while todo:
        p = spark._jvm.org.apache.hadoop.fs.Path(todo.pop())
        for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p):
            name = s.getPath().getName()
            if s.isDirectory() and not name.startswith(".") and name.lower() not in IGNORED_DIRECTORIES:
                todo.append(s.getPath().toString())
                if name.startswith("_"):
                    out.append(s.getPath().toString())
    return out


def scan(spark: SparkSession, root: str, tests: bool = False, wanted: list[str] | None = None) -> DataFrame:
    """(path, content, language) of the sources under ``root``, or of the ``wanted`` targets there; paths
    are relative to it.  A file that several targets hold comes once.  Links are followed as the
    file system does; a directory that holds itself by a link is an error there.  Directories whose names start with an
    underscore are looked into only with ``tests``."""
    places = targets(root, wanted) if wanted else [root]
    places += _underscored(spark, places) if tests else []
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(places)
    files = files.dropDuplicates(["path"]) if len(places) > 1 else files
    base = root.split(":", 1)[-1].rstrip("/") + "/"
    relative = F.substr(F.col("path"), F.instr(F.col("path"), base) + F.lit(len(base)))
    return source_files(files.select(relative.alias("path"), "content"), tests)


def require_languages(files: DataFrame, requested: list[str]) -> DataFrame:
    """``files`` of the ``requested`` languages, of all without any; a requested language without a file is
    an error."""
    if not requested:
        return files
    missing = missing_languages(files, requested)
    if missing:
        raise ValueError(f"no files of {', '.join(missing)}")
    return files.where(F.col("language").isin(requested))


def missing_languages(files: DataFrame, requested: list[str]) -> list[str]:
    """Requested languages of which there is no file."""
    found = {r[0] for r in files.select("language").distinct().collect()}
    return sorted(set(requested) - found)


def by_language(files: DataFrame) -> DataFrame:
    """(language, files): how many distinct paths of each language there are."""
    return files.groupBy("language").agg(F.countDistinct("path").alias("files"))


def check_inventory(returned: DataFrame, discovered: DataFrame) -> DataFrame:
    """(path, problem): paths that only one side has, and paths that were returned twice; none if all is well."""
    r = returned.groupBy("path").agg(F.count("*").alias("n"))
    j = r.join(discovered.select("path").distinct().withColumn("known", F.lit(True)), "path", "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("known").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return j.select("path", problem.alias("problem")).where("problem IS NOT NULL")
