"""Scoring: grouped maximum, residual, roll-ups, policies, gates, ranks, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut, rounds


def grouped_max(signals: DataFrame, file: str = "path", group: str = "grp") -> DataFrame:
    """For each group of a file its strongest signal, with the others it overlaps.

    ``signals`` has the two keys, ``component``, ``subject`` and ``value``.  Zero signals take no
    part; ties go to the first component, then subject.  An aggregate, so each task sums
    up its part before the shuffle.
    """
    order = F.struct((-F.col("value")).alias("v"), "component", "subject")
    live = signals.where("value <> 0")
    best = live.groupBy(file, group).agg(F.min(order).alias("best"), F.sort_array(F.collect_list(F.struct("component", F.col("value").alias("contribution")))).alias("signals"))
    return best.select(file, group, F.col("best.component").alias("component"), F.col("best.subject").alias("subject"), (-F.col("best.v")).alias("contribution"), "signals")


def residual(types: DataFrame, charges: DataFrame) -> DataFrame:
    """``types(owner, severity)`` less the ``charges(owner, contribution)`` of their routines."""
    total = charges.groupBy("owner").agg(F.sum("contribution").alias("charged"))
    return types.join(total, "owner", "left").withColumn("residual", F.greatest(F.lit(0.0), F.col("severity") - F.coalesce("charged", F.lit(0.0))))


def reweight(contribution: Column, default: float, weight: float | None, enabled: bool = True) -> Column:
    """A contribution under a policy: no weight is the default, an explicit zero stays zero."""
    if not enabled:
        return F.lit(0.0)
    return contribution * ((default if weight is None else weight) / default)


def ranked(scores: DataFrame, score: str, *ties: str) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), *ties)))


def top_ranked(scores: DataFrame, score: str, *ties: str, n: int) -> DataFrame:
    """The first ``n`` ranks: each task keeps its best ``n`` before any are gathered."""
    return ranked(scores.orderBy(F.desc(score), *ties).limit(n), score, *ties)


def gate(score: Column, complete: Column, most: float) -> Column:
    return complete & (score <= most)


def bucket(score: Column, width: float = 5.0, last: int = 20) -> Column:
    """Histogram bin; negative scores fall in the first, and the last takes all above."""
    return F.least(F.lit(last), F.floor(F.greatest(F.lit(0.0), score) / width)).cast("int")


def view_sort(df: DataFrame, value: str, tie: str, descending: bool = True) -> DataFrame:
    """Missing values last in either direction."""
    c = F.col(value)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie)


def places(df: DataFrame, *order: Column) -> DataFrame:
    """Every row with its ``place`` from 1 on in ``order``: sorted by ranges, numbered in each, and
    moved by the rows of the ranges before; no window over all rows."""
    n = F.monotonically_increasing_id()
    rows = cut(df.orderBy(*order).withColumn("_n", n)).withColumn("_part", F.shiftright("_n", 33))
    before, total = [], 0
    for part, size in sorted(tuple(r) for r in rows.groupBy("_part").count().collect()):
        before.append((part, total))
        total += size
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    place = F.col("_before") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(offsets), "_part").select(*df.columns, place.alias("place"))


def resample(bins: DataFrame, width: int, last: int = 20) -> DataFrame:
    """(place, files): a histogram ``bins(bin, files)`` on ``width`` columns.  With fewer columns than
    bins the last one is the overflow bin alone; with more, bins are repeated."""
    n = last + 1
    if width < n:
        spans = [(c * last // max(1, width - 1), (c + 1) * last // max(1, width - 1)) for c in range(width - 1)] + [(last, n)]
    else:
        spans = [(c * n // width, max((c + 1) * n // width, c * n // width + 1)) for c in range(width)]
    places = bins.sparkSession.createDataFrame([(c, b) for c, (lo, hi) in enumerate(spans) for b in range(lo, hi)], "place int, bin int")
    # at most one row for each column and bin
    return F.broadcast(places).join(bins, "bin", "left").groupBy("place").agg(F.coalesce(F.sum("files"), F.lit(0)).cast("long").alias("files"))


def state_rank(state: Column) -> Column:
    """Order of measurement states; the worst wins a merge."""
    return F.when(state == "unavailable", 3).when(state == "partial", 2).when(state == "measured", 1).otherwise(0)


def merge_boundaries(rows: DataFrame) -> DataFrame:
    """(boundary, state, score) of ``rows(boundary, state, score, fingerprint)``.

    The worst state counts.  Measured scores that differ, or inventories with different fingerprints,
    withhold the score and make the boundary unavailable; a boundary that is unavailable or not
    applicable has none.  With a column ``estimated``, one row that says so makes a measured boundary partial.
    """
    guess = F.coalesce(F.bool_or("estimated"), F.lit(False)) if "estimated" in rows.columns else F.lit(False)
    measured = F.when(F.col("state") == "measured", F.col("score"))
    known = F.when(F.coalesce("fingerprint", F.lit("")) != "", F.col("fingerprint"))
    g = rows.groupBy("boundary").agg(
        F.max_by("state", state_rank(F.col("state"))).alias("worst"), F.min(measured).alias("lo"), F.max(measured).alias("hi"),
        F.min(known).alias("first"), F.max(known).alias("last"), F.min("score").alias("some"), guess.alias("guess"),
    )
    conflict = F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)) | F.coalesce(F.col("first") != F.col("last"), F.lit(False))
    state = F.when(conflict, "unavailable").when(F.col("guess") & (F.col("worst") == "measured"), "partial").otherwise(F.col("worst"))
    return g.select("boundary", state.alias("state"), F.when(~state.isin("unavailable", "not_applicable"), F.coalesce("lo", "some")).alias("score"))


@rounds
def places_within(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """Every row with its ``place`` in its ``group``, without gathering a group in one task."""
    p = cut(places(df, F.col(group), *order))
    first = p.groupBy(group).agg(F.min("place").alias("_first"))
    return p.join(first, group).withColumn("place", F.col("place") - F.col("_first") + 1).select(*df.columns, "place")


def view_places(df: DataFrame, value: str, path: str, pending: str | None = None, descending: bool = True) -> DataFrame:
    """Every row with its ``place`` in a view: pending rows last, then rows without a value, in either
    direction; ties by path in lower case, then as it is."""
    c = F.col(value)
    order = [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.lower(path), F.col(path)]
    return places(df, *([F.col(pending).asc()] if pending else []), *order)


def find_next(df: DataFrame, path: str, place: str, query: str, cursor: int, direction: int = 1) -> DataFrame:
    """The next row behind ``cursor`` (a place) whose path holds ``query`` in any case of letters, in one of
    two directions and from the other end on; none if nothing is found."""
    total = df.agg(F.max(place)).first()[0] or 0
    steps = F.pmod((F.col(place) - F.lit(cursor + direction)) * direction, F.lit(max(1, total)))
    return df.where(F.lower(path).contains(query.lower())).withColumn("_steps", steps).orderBy("_steps").limit(1).drop("_steps")


def new_marker(rank: Column, total: Column, age_seconds: Column, moved: Column, window: float = 600) -> Column:
    """How a new file is marked: null once the window is over; ``unmoved``; by the share of ranks it has
    reached since (``top10``, ``top50``); else ``rest``."""
    within = lambda p: rank <= F.greatest(F.lit(1), F.floor((total * p + 99) / 100))
    return F.when(age_seconds < window, F.when(~moved, "unmoved").when(within(10), "top10").when(within(50), "top50").otherwise("rest"))


def fade(age_seconds: Column, window: float) -> Column:
    """How strongly an edit is shown: 1 when it happened, 0 from the end of the window on."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age_seconds / window))
