"""Written tables that cut a plan: they survive lost executors, and a plan doesn't grow with rounds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: Tables of the operators with rounds that are running, by thread.
_OPEN = threading.local()


def root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.  Where that is unset a
    temporary one stands in, in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        folder = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL.append("file://" + folder)
    return _LOCAL[0]


def cut(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """``df`` as a written table; its path is appended to ``made``."""
    spark = df.sparkSession
    path = f"{root(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    if (of := getattr(_OPEN, "made", None)) is not None:
        of.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that no plan needs any more."""
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


def rounds(operator):
    """An operator with rounds: its result is written, and every table that it cut on the way is deleted, also if it fails.  Tables
    of operators that it calls are its own."""

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        outer, made = getattr(_OPEN, "made", None), []
        _OPEN.made = made
        try:
            out = operator(*args, **kwargs)
            _OPEN.made = outer
            return cut(out)
        finally:
            _OPEN.made = outer
            if made:
                drop(SparkSession.active(), made)

    return run
