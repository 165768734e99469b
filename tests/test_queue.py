"""The queue of changed paths on a stream: quiet periods, one run at a time, retries by timer, restarts."""

import json

import pytest

from plumbline.streaming import queue
from plumbline.streaming.queue import Unit

SCHEMA = "unit string, at timestamp, event string, path string, run long"


def test_steps():
    u, paths = queue.apply(Unit(), "changed", None, 1000, 80, 250)
    assert (u.due, paths) == (1080, "queue") and queue.advance(u, 1079) == (u, False)
    u, _ = queue.apply(u, "changed", None, 1050, 80, 250)
    assert u.due == 1130
    u, take = queue.advance(u, 1130)
    assert take and (u.run, u.running, u.deadline()) == (1, True, -1)
    assert queue.apply(u, "done", 7, 1140, 80, 250) == (queue.replace(u, last=1140), "")  # a result of another run
    u, paths = queue.apply(u, "churned", 1, 1200, 80, 250)
    assert (paths, u.deadline(), u.state) == ("back", 1450, "stale_error")
    again, paths = queue.apply(u, "churned", 1, 1300, 80, 250)
    assert paths == "" and again.deadline() == 1450
    u, take = queue.advance(u, 1450)
    assert take and u.run == 2
    u, paths = queue.apply(u, "done", 2, 1500, 80, 250)
    assert paths == "clear" and not u.running


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_stream(rocks, tmp_path):
    """Late, repeated and restarted batches: each is a run of the query of its own, over one checkpoint."""
    at = lambda ms: f"2024-01-01T00:00:{ms // 1000:02}.{ms % 1000:03}Z"
    log, out = tmp_path / "log", tmp_path / "out"
    log.mkdir()
    batches = [
        [("u", 1000, "changed", "a", None), ("u", 1050, "changed", "b", None), ("u", 1050, "changed", "b", None), ("v", 1000, "changed", "x", None)],
        [("w", 1300, "verify", None, None)],  # only moves the watermark on: timers of u and v
        [("u", 1350, "changed", "c", None), ("u", 1320, "changed", "d", None), ("v", 1350, "failed", None, 1)],
        [("u", 1400, "done", None, 1), ("u", 1400, "done", None, 1), ("u", 1390, "changed", "e", None)],
        [("u", 1500, "churned", None, 2), ("u", 1510, "changed", "a", None), ("u", 1505, "churned", None, 2)],
        [("w", 2000, "verify", None, None)],
        [("u", 2100, "done", None, 3), ("u", 1, "changed", "lost", None)],  # far behind the watermark
    ]
    got = []
    for i, rows in enumerate(batches):
        (log / f"{i}.json").write_text("\n".join(json.dumps({"unit": u, "at": at(t), "event": e, "path": p, "run": r}) for u, t, e, p, r in rows))
        events = rocks.readStream.schema(SCHEMA).json(str(log))
        q = queue.analysis_queue(events, late="50 milliseconds")
        q.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    rows = rocks.read.parquet(str(out)).where("action = 'analyze'").selectExpr("unit", "unix_millis(at) % 100000 AS ms", "run", "path").collect()
    start = 1704067200000 % 100000
    got = sorted((r.unit, r.ms - start, r.run, r.path) for r in rows)
    assert got == [
        ("u", 1130, 1, "a"), ("u", 1130, 1, "b"), ("u", 1400, 2, "c"), ("u", 1400, 2, "d"), ("u", 1400, 2, "e"),
        ("u", 1750, 3, "a"), ("u", 1750, 3, "c"), ("u", 1750, 3, "d"), ("u", 1750, 3, "e"), ("v", 1080, 1, "x"),
    ]
