"""Stored results of units: keys of their inputs, generations of tables, and what is still good of them.

A generation is a folder of tables that never changes; a pointer names the current one.  Readers see the old or
the new generation, never a mixture, and a writer that lost its executors leaves the pointer alone.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph
from . import incremental as inc


def _lines(rows: DataFrame, kind: str, *parts: Column) -> DataFrame:
    """(unit, line): inputs of units as text, each part with its length before it."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    sized = [F.concat(F.char_length(text(c)).cast("string"), F.lit(":"), text(c)) for c in parts]
    return rows.select("unit", F.concat(F.lit(kind + "="), *sized).alias("line"))


def unit_keys(units: DataFrame, sources: DataFrame, configuration: DataFrame, dependencies: DataFrame, components: dict[str, str], options: dict) -> DataFrame:
    """(unit, language, key): SHA-256 over all that the results of ``units(unit, language)`` depend on, in any order:
    ``sources(unit, path, digest)``, ``configuration(unit, path, digest)``, ``dependencies(unit, dependency,
    fingerprint)``, the versions of the requested ``components`` and the ``options`` of the analysis.  How results are
    weighed, sorted and shown takes no part."""
    fixed = sorted(f"component={k}@{v}" for k, v in components.items()) + [f"options={json.dumps(options, sort_keys=True)}"]
    path = lambda c: F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^(\./)+|(?<=/)(\./)+", "")
    lines = (
        _lines(sources, "source", path(F.col("path")), F.col("digest"))
        .unionByName(_lines(configuration, "configuration", path(F.col("path")), F.col("digest")))
        .unionByName(_lines(dependencies, "dependency", F.col("dependency"), F.col("fingerprint")))
        .distinct()
    )
    hashed = inc.bucketed_fingerprint(lines.withColumn("line", F.sha2(F.col("line").cast("binary"), 256)), "unit", "line")
    own = F.concat_ws("\n", F.concat(F.lit("unit="), F.col("unit").cast("string")), F.concat(F.lit("language="), "language"), *[F.lit(x) for x in fixed], F.coalesce("fingerprint", F.lit("")))
    return units.join(hashed, "unit", "left").select("unit", "language", F.sha2(own.cast("binary"), 256).alias("key"))


def view_key(workspace: str, targets: list[str], languages: list[str], **options) -> str:
    """SHA-256 of what belongs to a view of a workspace: targets and languages in any order, and its scope."""
    view = {"workspace": workspace.rstrip("/"), "targets": sorted({t.strip("/") for t in targets}), "languages": sorted(set(languages)), **options}
    return hashlib.sha256(json.dumps(view, sort_keys=True).encode()).hexdigest()


def lookup(planned: DataFrame, stored: DataFrame) -> DataFrame:
    """``planned(unit, language, key)`` with ``hit``: whether ``stored(unit, language, key)`` has its key, for the same unit
    and language (a key of another unit is no hit)."""
    have = stored.select("key", F.col("unit").alias("_u"), F.col("language").alias("_l")).distinct()
    hit = (F.col("_u") == F.col("unit")) & (F.col("_l") == F.col("language"))
    j = planned.join(have, "key", "left").withColumn("hit", F.coalesce(hit, F.lit(False)))
    return j.groupBy("unit", "language", "key").agg(F.bool_or("hit").alias("hit"))


def all_stored(planned: DataFrame, stored: DataFrame) -> bool:
    """Whether every planned unit is stored under its key, so that what was shown last is still right."""
    return lookup(planned, stored).where("NOT hit").isEmpty()


def retry_units(stored: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """``stored`` without units that had a transient diagnostic (``diagnostics(unit, transient)``): they are
    analysed again."""
    return stored.join(diagnostics.where("transient").select("unit").distinct(), "unit", "left_anti")


def overlay(plan: dict[str, DataFrame], changed: dict[str, DataFrame], removed: DataFrame) -> dict[str, DataFrame]:
    """The tables of a ``plan``, each by ``unit``, with those of ``changed`` in place of the units that it has and without the
    units ``removed(unit)``.  Nothing changes until the result is committed: see :meth:`Generations.commit`."""
    touched = removed.select("unit")
    for df in changed.values():
        touched = touched.unionByName(df.select("unit"))
    touched = touched.distinct()
    out = {}
    for name, df in plan.items():
        kept = df.join(touched, "unit", "left_anti")
        out[name] = kept.unionByName(changed[name]) if name in changed else kept
    return out


def by_owner(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """``rows(path, ...)`` of a batch of units with the ``unit`` of ``owners(path, unit)``; paths of no unit go."""
    return rows.join(owners.select("path", "unit").distinct(), "path")


def boundaries_by_owner(boundaries: DataFrame, owners: DataFrame) -> DataFrame:
    """(unit, boundary, files) of ``boundaries(boundary, files)``: each unit gets those of the files that are its own."""
    each = boundaries.select("boundary", F.explode("files").alias("path"))
    return by_owner(each, owners).groupBy("unit", "boundary").agg(F.array_sort(F.collect_set("path")).alias("files"))


def visible(rows: DataFrame, allowed: DataFrame) -> DataFrame:
    """``rows(path, ...)`` whose path is among ``allowed(path)``."""
    return rows.join(allowed.select("path").distinct(), "path", "left_semi")


def compact(results: DataFrame) -> DataFrame:
    """``results`` as they are shown: without evidence and waivers."""
    return results.drop("evidence", "waivers")


def latest_components(rows: DataFrame, coverage: DataFrame) -> DataFrame:
    """``rows(path, component, version, ...)`` of the last version of ``coverage(path, component, version)``: a later
    result takes the place of an earlier one, even if it has no rows."""
    last = coverage.groupBy("path", "component").agg(F.max("version").alias("version"))
    return rows.join(last, ["path", "component", "version"], "left_semi")


def merge_diagnostics(old: DataFrame, new: DataFrame, affected: DataFrame, replaced: DataFrame) -> DataFrame:
    """``old`` without those of ``affected(path)`` and ``replaced(unit)``, then ``new``; equal ones but for their invocation
    once (``path, unit, severity, code, message, invocation``)."""
    kept = old.join(affected.select("path").distinct(), "path", "left_anti").join(replaced.select("unit").distinct(), "unit", "left_anti")
    same = ["path", "unit", "severity", "code", "message"]
    return kept.unionByName(new).groupBy(*same).agg(F.min("invocation").alias("invocation"))


def content_digest(rows: DataFrame) -> str:
    """SHA-256 of the rows of a table in any order, repeated ones included."""
    each = rows.select(F.lit(1).alias("one"), F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).cast("binary"), 256).alias("h"))
    got = inc.bucketed_fingerprint(each, "one", "h").first()
    return got["fingerprint"] if got else hashlib.sha256(b"").hexdigest()


class Generations:
    """Versions of the tables of a view, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, view: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/{view}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def current(self) -> int | None:
        """Number of the current generation, None before the first."""
        fs, p = self._fs(f"{self.folder}/current")
        if not fs.exists(p):
            return None
        numbers = [int(s.getPath().getName()) for s in fs.listStatus(p)]
        return max(numbers) if numbers else None

    def load(self, table: str, generation: int | None = None) -> DataFrame:
        n = self.current() if generation is None else generation
        if n is None:
            raise LookupError("nothing was stored yet")
        return self.spark.read.parquet(f"{self.folder}/generation={n}/{table}")

    def commit(self, tables: dict[str, DataFrame], verify=None, partitions: int | None = None) -> int:
        """Write ``tables`` as the next generation and make it the current one; its number.  ``verify`` is called
        between the two: what it raises leaves the old generation current.  Of two writers at once the second
        to publish fails."""
        n = (self.current() or 0) + 1
        for name, df in tables.items():
            df = df if partitions is None else df.coalesce(partitions)
            df.write.mode("overwrite").parquet(f"{self.folder}/generation={n}/{name}")
        if verify is not None:
            verify()
        # the pointer is an empty file by the generation's name: that is created whole or not at all
        fs, p = self._fs(f"{self.folder}/current/{n}")
        try:
            fs.create(p, False).close()
        except Exception as e:
            raise RuntimeError(f"generation {n} was published by another writer") from e
        return n

    def compact(self, table: str, partitions: int = 1) -> tuple[int, int]:
        """Write the current generation of ``table`` in fewer files, as a next generation; files before and after."""
        n, fs = self.current(), None
        names = [s.getPath().getName() for s in self._fs(f"{self.folder}/generation={n}")[0].listStatus(self._fs(f"{self.folder}/generation={n}")[1])]
        count = lambda k: sum(x.endswith(".parquet") for x in (s.getPath().getName() for s in self._fs(f"{self.folder}/generation={k}/{table}")[0].listStatus(self._fs(f"{self.folder}/generation={k}/{table}")[1])))
        m = self.commit({x: self.load(x, n).coalesce(partitions) if x == table else self.load(x, n) for x in names})
        return count(n), count(m)

    def prune(self, keep: int = 2) -> list[int]:
        """Delete all generations but the last ``keep`` published ones; their numbers."""
        current = self.current()
        if current is None:
            return []
        fs, p = self._fs(self.folder)
        gone = []
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith("generation=") and int(name.split("=")[1]) <= current - keep:
                fs.delete(s.getPath(), True)
                gone.append(int(name.split("=")[1]))
        return sorted(gone)


def unchanged(before: DataFrame, after: DataFrame):
    """A ``verify`` for :meth:`Generations.commit`: raises if inputs ``(path, size, mtime)`` changed meanwhile."""

    def check() -> None:
        changed = graph.changed_files(before, after).limit(5).collect()
        if changed:
            raise RuntimeError("inputs changed during the analysis: " + ", ".join(r.path for r in changed))

    return check
