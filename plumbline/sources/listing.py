"""Listing a tree of files on the executors, a level at a time, with a policy for symbolic links."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut, rounds

_FOUND = "path string, real string, kind string, size long, mtime double, broken boolean"
#: Directories that a task lists.
_EACH = 50


def _entries(folder: str, links: str) -> Iterator[tuple]:
    """(path, real path, kind, size, mtime, broken) of what is right in a folder."""
    with os.scandir(folder) as found:
        for e in sorted(found, key=lambda e: e.name):
            linked = e.is_symlink()
            if linked and links == "error":
                raise ValueError(f"{e.path} is a symbolic link")
            if linked and links == "skip":
                continue
            try:
                s = e.stat()
            except OSError:  # it leads nowhere, or in a circle
                yield e.path, None, "link", None, None, True
                continue
            kind = "directory" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "other"
            yield e.path, os.path.realpath(e.path), kind, s.st_size, s.st_mtime, False


@rounds
def tree(spark: SparkSession, root: str, links: str = "follow", ignored: tuple[str, ...] = ()) -> DataFrame:
    """(path, real, size, mtime) of the regular files below ``root``, a folder that all executors see; paths are relative to it.

    ``links``: ``follow`` them, ``skip`` them, or take any as an ``error``.  A directory is visited once, by its real path, so links that
    lead in a circle end, and a directory that is reached in several ways has its files by the first of them: the nearest to the
    root, then the first by name.  A file that links lead to as well comes once, in the same way.  Links to nowhere and
    directories named in ``ignored`` are left out.  Each level is one round, its directories dealt to tasks; a wide level is
    listed by many of them, and nothing but counts reaches the driver.
    """
    if links not in ("follow", "skip", "error"):
        raise ValueError(f"no such policy: {links}")
    base = os.path.realpath(root.removeprefix("file://"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for folder in b["path"]:
                rows = list(_entries(folder, links))
                yield pd.DataFrame(rows, columns=["path", "real", "kind", "size", "mtime", "broken"]).astype({"size": "Int64", "mtime": "Float64"})

    schema, seen, files, level = "path string, real string", [], [], 0
    fresh = cut(spark.createDataFrame([(base, base)], schema), seen)
    while not fresh.isEmpty():
        tasks = max(1, -(-fresh.count() // _EACH))
        found = cut(fresh.select("path").repartition(tasks, "path").mapInPandas(run, _FOUND).where("NOT broken"))
        cut(found.where("kind = 'file'").select("path", "real", "size", "mtime", F.lit(level).alias("level")), files)
        name = F.substring_index("path", "/", -1)
        down = found.where(F.col("kind") == "directory").where(~name.isin(*ignored) if ignored else F.lit(True))
        once = down.groupBy("real").agg(F.min("path").alias("path")).select("path", "real")
        fresh = cut(once.join(spark.read.schema(schema).parquet(*seen).select("real"), "real", "left_anti").select("path", "real"), seen)
        level += 1
    all_ = spark.read.schema("path string, real string, size long, mtime double, level int").parquet(*files)
    first = all_.groupBy("real").agg(F.min(F.struct("level", "path", "size", "mtime")).alias("f"))
    return first.select(F.expr(f"substring(f.path, {len(base) + 2})").alias("path"), "real", "f.size", "f.mtime")
