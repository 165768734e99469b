"""Analyzers that are programs of their own: files in and records out, both as JSON lines."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import protocol


def analyze(files: DataFrame, command: list[str], invocation: str, seconds: float = 600, each: int = 200) -> DataFrame:
    """(record, failure) of a ``command`` that is run on the executors on ``files(path, content)``, by ``each`` files.

    It gets a line for each file on its input, ``{"invocation_id", "path", "content"}``, and writes records; the last one is
    ``terminal``.  A run that fails, takes more than ``seconds`` or doesn't end so gives no record but one ``failure`` for
    each of its files (a JSON coverage record with the state ``failed``), and concerns no other run."""

    def one(rows: list[tuple[str, str]]) -> Iterator[tuple[str | None, str | None]]:
        text = "".join(json.dumps({"invocation_id": invocation, "path": p, "content": c}) + "\n" for p, c in rows)
        try:
            done = subprocess.run(command, input=text, capture_output=True, text=True, timeout=seconds, check=True)
            lines = [x for x in done.stdout.splitlines() if x.strip()]
            kinds = [json.loads(x).get("type") for x in lines]
            if kinds.count("terminal") != 1 or kinds[-1] != "terminal":
                raise ValueError("the records don't end with their one terminal record")
        except (OSError, subprocess.SubprocessError, ValueError, AttributeError) as e:
            for p, _ in rows:
                yield None, json.dumps({"type": "coverage", "protocol_version": 1, "invocation_id": invocation, "path": p, "state": "failed", "reason": type(e).__name__})
            return
        yield from ((x, None) for x in lines[:-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = list(zip(b["path"].tolist(), b["content"].tolist()))
            for at in range(0, len(rows), each):
                yield pd.DataFrame(list(one(rows[at : at + each])), columns=["record", "failure"])

    return files.select("path", F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content")).mapInPandas(run, "record string, failure string")


def tables(found: DataFrame) -> dict[str, DataFrame]:
    """The measurements and coverage of what ``analyze`` gives, as :func:`protocol.read` has them."""
    r = found.select(F.from_json(F.coalesce("record", "failure"), protocol.SCHEMA, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    measured = r.where("type = 'measurement'").withColumn("number", protocol.number(F.col("value")))
    return {"measurement": measured.select("component_id", "path", "number", "subject", "attributes"), "coverage": r.where("type = 'coverage'").select("component_id", "path", "state", "reason")}
