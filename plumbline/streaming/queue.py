"""The queue of changed paths: a quiet period, one analysis at a time, and a retry after the inputs moved.

An event-time state machine for each unit, on a stream.  State lies in the state store, so a restart goes on where it
stopped, and timers fire as the watermark passes them.  The session needs the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .ranks import FRESHNESS

_OUT = "unit string, at timestamp, run long, action string, path string"
_STATE = "state string, run long, running boolean, due long, retry long, last long"
#: Rows of a frame that is given on.
_ROWS = 10_000
_NEVER = -1


@dataclass(frozen=True)
class Unit:
    """What is known of a unit.  Times are milliseconds; ``due`` ends the quiet period, ``retry`` the wait before an analysis is
    tried again, and -1 is none."""

    state: str = "provisional"
    run: int = 0
    running: bool = False
    due: int = _NEVER
    retry: int = _NEVER
    last: int = _NEVER

    def deadline(self) -> int:
        """When something is to be done next, by the clock alone."""
        if self.retry != _NEVER:
            return self.retry
        return _NEVER if self.running else self.due


def advance(unit: Unit, now: int) -> tuple[Unit, bool]:
    """The unit at ``now``, and whether its queue is to be taken."""
    at = unit.deadline()
    if at == _NEVER or at > now:
        return unit, False
    return replace(unit, run=unit.run + 1, running=True, due=_NEVER, retry=_NEVER, state=FRESHNESS.get((unit.state, "changed"), unit.state)), True


def apply(unit: Unit, event: str, run: int | None, now: int, quiet: int, retry: int) -> tuple[Unit, str]:
    """The unit after an event, and what happens to its paths: ``queue`` the event's path, ``back`` to the queue with those that are
    being analysed, ``clear`` those, or nothing.

    A change starts the quiet period anew.  Results count only if they are of the run that is on: those of an earlier run, and
    repeated ones, change nothing.  After ``churned`` (the inputs moved while they were read) all is tried again once
    ``retry`` is over; further ones meanwhile don't put that off.
    """
    unit = replace(unit, last=max(unit.last, now))
    if event == "changed":
        return replace(unit, due=max(unit.due, now + quiet), state=FRESHNESS.get((unit.state, event), unit.state)), "queue"
    if event in ("done", "failed", "churned"):
        if not unit.running or unit.retry != _NEVER or run != unit.run:
            return unit, ""
        if event == "churned":
            return replace(unit, state="stale_error", retry=now + retry), "back"
        return replace(unit, running=False, state=FRESHNESS.get((unit.state, event), unit.state)), "clear"
    return replace(unit, state=FRESHNESS.get((unit.state, event), unit.state)), ""


class _Queue(StatefulProcessor):
    def __init__(self, quiet: int, retry: int, idle: int) -> None:
        self.quiet, self.retry, self.idle = quiet, retry, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.unit = handle.getValueState("unit", _STATE)
        self.waiting = handle.getMapState("waiting", "path string", "at long")
        self.taken = handle.getMapState("taken", "path string", "at long")

    def _load(self) -> Unit:
        return Unit(*self.unit.get()) if self.unit.exists() else Unit()

    def _save(self, unit: Unit) -> None:
        self.unit.update((unit.state, unit.run, unit.running, unit.due, unit.retry, unit.last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        at = unit.deadline()
        self.handle.registerTimer(at if at != _NEVER else unit.last + self.idle)

    def _paths(self) -> Iterator[str]:
        """The queue's paths, which are moved to those being analysed."""
        for (path,), (at,) in self.waiting.iterator():
            self.taken.updateValue((path,), (at,))
            yield path
        self.waiting.clear()

    def _due(self, unit: Unit, now: int) -> tuple[Unit, Iterable[tuple]]:
        at = unit.deadline()
        unit, take = advance(unit, now)
        return unit, ((at, unit.run, "analyze", p) for p in self._paths()) if take else ()

    def _frames(self, key: tuple, rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def frame() -> pd.DataFrame:
            out = pd.DataFrame(held, columns=["at", "run", "action", "path"])
            out["at"] = pd.to_datetime(out["at"], unit="ms")
            out.insert(0, "unit", key[0])
            return out

        for row in rows:
            held.append(row)
            if len(held) == _ROWS:
                yield frame()
                held = []
        if held:
            yield frame()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._frames(key, self._events(rows))

    def _events(self, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        unit = self._load()
        for batch in rows:
            batch = batch.sort_values("at", kind="stable")
            times = batch["at"].to_numpy("datetime64[ms]").astype("int64").tolist()
            for now, event, path, run in zip(times, batch["event"], batch["path"], batch["run"], strict=True):
                now = max(now, unit.last)  # what comes late counts when it comes
                unit, due = self._due(unit, now)
                yield from due
                before = unit.state
                unit, paths = apply(unit, event, None if pd.isna(run) else int(run), now, self.quiet, self.retry)
                if paths == "queue" and path is not None:
                    self.waiting.updateValue((path,), (now,))
                elif paths == "back":
                    for p, at in self.taken.iterator():
                        self.waiting.updateValue(p, at)
                if paths in ("back", "clear"):
                    self.taken.clear()
                if unit.state != before:
                    yield now, unit.run, unit.state, None
                if paths == "clear" and self.waiting.exists():  # what came meanwhile is taken at once
                    unit = replace(unit, due=now)
                    unit, due = self._due(unit, now)
                    yield from due
        self._save(unit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        unit = self._load()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if unit.deadline() == _NEVER:  # nothing waits, and nothing came for long
            if not unit.running and now >= unit.last + self.idle:
                self.unit.clear()
            elif unit.running:
                self.handle.registerTimer(now + self.idle)
            return
        unit, due = self._due(unit, now)
        yield from self._frames(key, due)
        self._save(unit)

    def close(self) -> None:
        pass


def analysis_queue(events: DataFrame, quiet: int = 80, retry: int = 250, idle: int = 3_600_000, late: str = "10 seconds") -> DataFrame:
    """(unit, at, run, action, path) of a *streaming* ``events(unit, at, event, path, run)``, in milliseconds.

    ``changed`` queues a path of the unit.  Once no change came for ``quiet`` the queue is taken: a row ``analyze`` for each path, with
    the number of the run.  While a run is on, changes wait; they are taken when it is ``done`` or ``failed``.  A run that ends
    as ``churned`` is tried again after ``retry``, with what came meanwhile.  Other rows tell a new freshness of
    the unit, without a path.  Events may repeat, and come up to ``late`` behind the last; a unit of which nothing was heard for ``idle``
    is forgotten.  A path queued twice is taken once.  Rows without a unit belong together; a change without a path only starts the
    quiet period.
    """
    rows = events.select("unit", "at", "event", "path", "run").withWatermark("at", late)
    return rows.groupBy("unit").transformWithStateInPandas(_Queue(quiet, retry, idle), _OUT, "append", "eventTime")
