"""Views of results and jobs: lists, goals, progress, distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import bucket, places

# How jobs are ordered.
JOB_ORDERS = ("attention", "state", "agent", "goal", "target", "time", "activity")


def jobs(table: DataFrame, query: str = "", finished: bool = False, order: str = "attention", reverse: bool = False) -> DataFrame:
    """(id, place) of the jobs that are shown, from ``table(id, phase, attention, state, agent, goal, target, time,
    activity)``.  Discarded jobs aren't, completed and canceled ones only with ``finished``; a query is sought in all
    texts in any case of letters.  Ties stay in the order of ids in either direction."""
    if order not in JOB_ORDERS:
        raise ValueError(f"jobs are ordered by {', '.join(JOB_ORDERS)}")
    hidden = ["discarded"] if finished else ["discarded", "completed", "canceled"]
    out, wanted = table.where(~F.col("phase").isin(hidden)), query.strip().lower()
    if wanted:
        out = out.where(F.lower(F.concat_ws("\n", F.col("id").cast("string"), "state", "agent", "goal", "target", "activity")).contains(wanted))
    c = F.lower(order) if order in ("state", "agent", "goal", "activity") else F.col(order)
    return places(out.select("id", c.alias("_by")), F.col("_by").desc_nulls_last() if reverse else F.col("_by").asc_nulls_last(), F.col("id")).drop("_by")


def verify_goals(baseline: DataFrame, current: DataFrame, scores: DataFrame, focus: dict[str, float], allowance: dict[str, float], most: float, complete: bool = True) -> DataFrame:
    """(path, met, too_high, regressed): whether each file of ``scores(path, score, complete)`` meets its goal.

    Its score may be ``most`` at most; the metrics in ``focus`` must be complete and within their maximum; other
    metrics that were complete in ``baseline(path, metric, value, complete)`` must still be so in ``current`` and
    may have risen by their ``allowance`` (0) at most; with ``complete`` the file must be complete.
    """
    number = lambda table, key: F.try_element_at(F.create_map(*([F.lit(x) for p in table.items() for x in (p[0], float(p[1]))] or [F.lit(""), F.lit(0.0)])), key)
    now = current.select("path", "metric", F.col("value").alias("v"), F.col("complete").alias("c"))
    wanted = scores.select("path", F.explode(F.array(*[F.lit(k) for k in focus]) if focus else F.array().cast("array<string>")).alias("metric"))
    missed = wanted.join(now, ["path", "metric"], "left").where(~F.coalesce(F.col("c"), F.lit(False)) | (F.col("v") > number(focus, F.col("metric"))))
    high = missed.groupBy("path").agg(F.array_sort(F.collect_list("metric")).alias("too_high"))
    before = baseline.where("complete").where(~F.col("metric").isin(list(focus)) if focus else F.lit(True)).select("path", "metric", F.col("value").alias("b"))
    worse = before.join(now, ["path", "metric"], "left").where(~F.coalesce(F.col("c"), F.lit(False)) | (F.col("v") > F.col("b") + F.coalesce(number(allowance, F.col("metric")), F.lit(0.0))))
    worse = worse.groupBy("path").agg(F.array_sort(F.collect_list("metric")).alias("regressed"))
    none = F.array().cast("array<string>")
    j = scores.join(high, "path", "left").join(worse, "path", "left")
    ok = (F.col("score") <= most) & F.col("too_high").isNull() & F.col("regressed").isNull()
    return j.select("path", (ok & F.col("complete") if complete else ok).alias("met"), F.coalesce("too_high", none).alias("too_high"), F.coalesce("regressed", none).alias("regressed"))


def distribution(files: DataFrame) -> DataFrame:
    """(bin, files, current) of ``files(score, pending, failed, fresh)``; bin null is what has no score: pending or failed
    files and scores that aren't finite.  ``current`` counts those that are fresh."""
    finite = ~F.isnan("score") & (F.abs(F.col("score")) < float("inf"))
    shown = ~F.col("pending") & ~F.col("failed") & F.coalesce(finite, F.lit(False))
    return files.groupBy(F.when(shown, bucket(F.col("score"))).alias("bin")).agg(F.count("*").alias("files"), F.sum((shown & F.col("fresh")).cast("long")).alias("current"))


def progress(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """(language, total, finished): how far a scan is, from the number of files that ``expected(language, files)`` says and
    ``seen(path, language, pending)``, of which the last row of a path counts (by ``at``)."""
    last = seen.groupBy("path").agg(F.max_by(F.struct("language", "pending"), "at").alias("l")).select("path", "l.language", "l.pending")
    s = last.groupBy("language").agg(F.count("*").alias("seen"), F.sum((F.size("pending") == 0).cast("long")).alias("finished"))
    e = expected.groupBy("language").agg(F.max("files").alias("files"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return e.join(s, "language", "full").select("language", F.greatest(zero("files"), zero("seen")).alias("total"), zero("finished").alias("finished"))


def cell(value: Column, available: Column, failed: Column) -> Column:
    """A number in a view: ``X`` where its analysis failed, ``-`` where it isn't there yet."""
    return F.when(failed, "X").when(~available | value.isNull(), "-").otherwise(F.format_string("%.1f", value.cast("double")))


# Units of durations, in seconds.
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(text: Column) -> Column:
    """Seconds of a duration such as ``1h30m``, ``5m2h``, ``.5s``, ``100us``, ``-1.5ms`` or ``0``: numbers with units in any order; null if it
    isn't one.  Zero has no sign."""
    part = rf"(\d+\.?\d*|\.\d+)({'|'.join(_UNITS)})"
    units = F.create_map(*[F.lit(x) for pair in _UNITS.items() for x in pair])
    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(part), 1), F.regexp_extract_all(text, F.lit(part), 2), lambda n, u: n.cast("double") * F.element_at(units, u))
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    whole = F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)
    return F.when(text.rlike(rf"^[-+]?({part})+$"), sign * whole + 0.0).when(text.rlike(r"^[-+]?0$"), 0.0)
