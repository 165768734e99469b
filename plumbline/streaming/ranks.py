"""Rank history of files on a stream of snapshots, and the freshness of what is shown."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "path string, at timestamp, rank int, score double, points int, movement int, direction int"
_STATE = "ats array<timestamp>, ranks array<int>, score double, movement int, direction int"

# How what is shown moves on: state after (state, event).
FRESHNESS = {
    ("provisional", "verify"): "verifying", ("current", "verify"): "verifying", ("stale_error", "verify"): "verifying",
    ("verifying", "changed"): "refreshing", ("current", "changed"): "refreshing", ("stale_error", "changed"): "refreshing",
    ("verifying", "done"): "current", ("refreshing", "done"): "current",
    ("verifying", "failed"): "stale_error", ("refreshing", "failed"): "stale_error",
}


def fold(state: tuple | None, rows: Iterable[tuple], window: pd.Timedelta) -> tuple[tuple, list[tuple]]:
    """The state of one path after snapshots (at, rank, score) in time order, and a row for each.

    A point is kept where the rank changed; points older than the window go, but never the last.
    Movement is the oldest kept rank less the current one, taken anew when the score changes.
    """
    ats, ranks, last, movement, direction = state or ([], [], None, 0, 0)
    ats, ranks, out = list(ats), list(ranks), []
    for at, rank, score in rows:
        if not ranks or ranks[-1] != rank:
            ats.append(at)
            ranks.append(rank)
        old = sum(pd.Timestamp(a) < at - window for a in ats[:-1])
        ats, ranks = ats[old:], ranks[old:]
        if last is not None and score != last:
            movement, direction = ranks[0] - rank, (score > last) - (score < last)
        last = score
        out.append((at, rank, score, len(ranks), movement, direction))
    return (ats, ranks, last, movement, direction), out


def rank_history(snapshots: DataFrame, window: str = "10 minutes") -> DataFrame:
    """(path, at, rank, score, points, movement, direction) for each row of a *streaming*
    ``snapshots(path, at, rank, score)``.  State is one short list a path, bounded by the window."""
    span = pd.Timedelta(window)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        now, out = fold(state.get if state.exists else None, rows[["at", "rank", "score"]].itertuples(index=False, name=None), span)
        state.update(([pd.Timestamp(a).to_pydatetime() for a in now[0]], [int(r) for r in now[1]], float(now[2]), int(now[3]), int(now[4])))
        frame = pd.DataFrame(out, columns=["at", "rank", "score", "points", "movement", "direction"])
        frame.insert(0, "path", key[0])
        yield frame

    return snapshots.select("path", "at", "rank", "score").groupBy("path").applyInPandasWithState(run, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def movements(snapshots: DataFrame, window: int = 7) -> DataFrame:
    """(path, at, rank, score, movement, direction) of a *batch* ``snapshots(path, at, rank, score)`` with whole
    numbers ``at``: the oldest rank within ``window`` before a point less its own, and whether the
    score rose or fell."""
    by = Window.partitionBy("path").orderBy("at")
    moved = F.first("rank").over(by.rangeBetween(-window, 0)) - F.col("rank")
    return snapshots.select("path", "at", "rank", "score", moved.alias("movement"), F.signum(F.col("score") - F.lag("score").over(by)).alias("direction"))


def histogram_moves(old: DataFrame, new: DataFrame, bin: str = "bin") -> DataFrame:
    """(bin, files) to add to a histogram so that it goes from ``old(path, bin)`` to ``new(path, bin)``."""
    signed = new.select(bin, F.lit(1).alias("n")).unionByName(old.select(bin, F.lit(-1).alias("n")))
    return signed.groupBy(bin).agg(F.sum("n").cast("long").alias("files")).where("files <> 0")


def current(rows: DataFrame) -> DataFrame:
    """Rows of the last ``generation`` of each scope; late answers of earlier ones go.  The last generations are one row a
    scope, summed up in each task; rows of no scope belong together."""
    last = rows.groupBy(F.col("scope").alias("_scope")).agg(F.max("generation").alias("_last"))
    return rows.join(last, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("generation") == F.col("_last"))).select(*rows.columns)


def freshness(events: DataFrame) -> DataFrame:
    """(unit, state) after ``events(unit, at, event)`` in time order, from provisional; an event
    that doesn't apply to the state changes nothing."""
    pairs = F.create_map(*[F.lit(x) for (s, e), t in FRESHNESS.items() for x in (f"{s}/{e}", t)])
    log = F.array_sort(F.collect_list(F.struct("at", "event")))
    step = lambda s, e: F.coalesce(F.try_element_at(pairs, F.concat_ws("/", s, e["event"])), s)
    return events.groupBy("unit").agg(log.alias("log")).select("unit", F.aggregate("log", F.lit("provisional"), step).alias("state"))


def partial(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, pending, complete): the components of ``expected(path, component)`` whose coverage in
    ``observed(path, component, state)`` isn't closed yet."""
    closed = observed.where("state IN ('complete', 'failed', 'unavailable')").select("path", "component").distinct().withColumn("closed", F.lit(True))
    j = expected.select("path", "component").distinct().join(closed, ["path", "component"], "left")
    waiting = F.array_sort(F.collect_list(F.when(F.col("closed").isNull(), F.col("component"))))
    return j.groupBy("path").agg(waiting.alias("pending")).withColumn("complete", F.size("pending") == 0)
