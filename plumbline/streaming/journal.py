"""A bounded journal of changes as a streaming source with offsets, replay, and losses that are told.

A watcher appends changes to segment files, each named by the numbers of its changes.  A journal keeps so many segments; if the stream
lags behind, the oldest go.  The stream's offset is the number of the next change: what lies between two offsets is read
again after a failure, and numbers whose segments are gone make one row with ``all``, so that everything is looked at again.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "number long, path string, op int, ts timestamp, all boolean"


def segments(folder: str) -> list[tuple[int, int, str]]:
    """(first, behind the last, name) of the segments of a journal, in order."""
    found = []
    for name in os.listdir(folder):
        stem, _, kind = name.partition(".")
        if kind == "json" and stem[0] != "_":
            first, last = stem.split("-")
            found.append((int(first), int(last), name))
    return sorted(found)


class Journal:
    """The writer of a folder that all executors share; one at a time."""

    def __init__(self, folder: str, most: int = 1000) -> None:
        self.folder, self.most = folder, most
        os.makedirs(folder, exist_ok=True)
        there = segments(folder)
        self.next = there[-1][1] if there else 0

    def append(self, changes: list[tuple]) -> None:
        """Add changes (path, op, ts as text); with more than ``most`` segments the oldest go.  A segment is there whole or not at all."""
        if not changes:
            return
        behind = self.next + len(changes)
        temporary = os.path.join(self.folder, f"_{uuid.uuid4().hex}")
        with open(temporary, "w") as f:
            f.writelines(json.dumps([self.next + i, *c]) + "\n" for i, c in enumerate(changes))
        os.rename(temporary, os.path.join(self.folder, f"{self.next:020d}-{behind:020d}.json"))
        self.next = behind
        there = segments(self.folder)
        for _, _, name in there[: max(0, len(there) - self.most)]:
            os.remove(os.path.join(self.folder, name))


@dataclass
class Piece(InputPartition):
    """Changes ``first`` to ``behind`` - 1, of a segment or lost (no name)."""

    first: int
    behind: int
    name: str


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"next": 0}

    def latestOffset(self) -> dict:
        there = segments(self.folder)
        return {"next": there[-1][1] if there else 0}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, at = [], start["next"]
        for first, behind, name in segments(self.folder):
            if behind <= at or first >= end["next"]:
                continue
            if first > at:
                out.append(Piece(at, first, ""))
            out.append(Piece(max(at, first), min(behind, end["next"]), name))
            at = behind
        if at < end["next"]:
            out.append(Piece(at, end["next"], ""))
        return out

    def read(self, part: Piece) -> Iterator[tuple]:
        from datetime import datetime

        lost = (part.first, None, None, None, True)
        if not part.name:
            yield lost
            return
        try:
            f = open(os.path.join(self.folder, part.name))
        except FileNotFoundError:  # it went between plan and read
            yield lost
            return
        with f:
            for line in f:
                number, path, op, ts = json.loads(line)
                if part.first <= number < part.behind:
                    yield number, path, op, datetime.fromisoformat(ts), False

    def commit(self, end: dict) -> None:
        """Segments stay until the writer needs their place, so other streams can read them."""


class ChangeJournal(DataSource):
    """``spark.readStream.format("change_journal").option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "change_journal"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"].removeprefix("file://"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChangeJournal)
