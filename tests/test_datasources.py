"""Framed fact streams and the journal of changes."""

import os

import pytest

from plumbline.sources import frames
from plumbline.streaming import changes, journal


def test_frames(spark, tmp_path):
    frames.register(spark)
    rows = [{"type": "depth", "group": f"g{i % 3}", "paths": [f"p{i}", "é"], "payload": '{"n": %d}' % i} for i in range(500)] + [{"type": "progress", "stage": "flow", "completed": 3, "total": 9}, {"type": "end", "payload": {"x": [1]}}]
    (tmp_path / "in").mkdir()
    frames.write(f"file://{tmp_path}/in/a.frames", rows)
    frames.write(str(tmp_path / "in" / "b.frames"), rows[:7])
    (tmp_path / "in" / "_c").write_text("no frames")
    df = spark.read.format("fact_frames").option("targetBytes", 4000).load(f"file://{tmp_path}/in")
    assert df.rdd.getNumPartitions() > 5
    got = sorted((r.file, r.frame, r.type, r.group, r.paths, r.stage, r.completed, r.payload) for r in df.collect())
    want = [(f, i, v["type"], v.get("group"), v.get("paths"), v.get("stage"), v.get("completed"), v["payload"] if isinstance(v.get("payload"), str) else '{"x": [1]}' if "payload" in v else None) for f, rs in (("a.frames", rows), ("b.frames", rows[:7])) for i, v in enumerate(rs)]
    assert got == want
    assert spark.read.format("fact_frames").load(str(tmp_path / "in" / "b.frames")).count() == 7
    (tmp_path / "empty").write_bytes(b"")
    assert spark.read.format("fact_frames").load(str(tmp_path / "empty")).count() == 0


@pytest.mark.parametrize("damage", ["cut", "long", "text", "kind"])
def test_damaged_frames(spark, tmp_path, damage):
    frames.register(spark)
    path = tmp_path / "x"
    frames.write(str(path), [{"type": "depth"}] * 20)
    whole = path.read_bytes()
    path.write_bytes({"cut": whole[:-3], "long": whole + b"\xff\xff\xff\xff", "text": whole + b"\x00\x00\x00\x02{x", "kind": whole + b"\x00\x00\x00\x02[]"}[damage])
    with pytest.raises(Exception, match="frame 20|frame 19"):
        spark.read.format("fact_frames").load(str(path)).count()


def test_journal(spark, tmp_path):
    """Restarts repeat nothing and lose nothing; what went before it was read is one loss, then the stream goes on."""
    journal.register(spark)
    folder, out = str(tmp_path / "journal"), str(tmp_path / "out")
    j = journal.Journal(folder, most=3)
    add = lambda *paths: j.append([(p, 1, "2024-01-01T00:00:00") for p in paths])

    def run():
        stream = spark.readStream.format("change_journal").option("path", folder).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.number, r.path, r["all"]) for r in spark.read.schema(journal.SCHEMA).parquet(out).collect())

    add("a", "b")
    add("c")
    assert run() == [(0, "a", False), (1, "b", False), (2, "c", False)]
    add("d")
    want = [(0, "a", False), (1, "b", False), (2, "c", False), (3, "d", False)]
    assert run() == want and run() == want
    j = journal.Journal(folder, most=3)  # the writer is started anew, too
    for p in "efghi":
        add(p)
    got = run()
    assert got == [*want, (4, None, True), (6, "g", False), (7, "h", False), (8, "i", False)]
    assert len(os.listdir(folder)) == 3
    df = spark.read.schema(journal.SCHEMA).parquet(out)
    assert changes.losses(df).first().losses == 1


def test_journal_replays_between_offsets(tmp_path):
    j = journal.Journal(str(tmp_path), most=10)
    j.append([("a", 1, "2024-01-01T00:00:00"), ("b", 2, "2024-01-01T00:00:00"), ("c", 2, "2024-01-01T00:00:00")])
    j.append([("d", 1, "2024-01-01T00:00:00")])
    s = journal._Stream(str(tmp_path))
    assert s.latestOffset() == {"next": 4}
    read = lambda a, b: [r[1] for p in s.partitions({"next": a}, {"next": b}) for r in s.read(p)]
    assert read(1, 4) == ["b", "c", "d"] == read(1, 4) and read(0, 2) == ["a", "b"] and read(4, 4) == []
    lost = s.partitions({"next": 0}, {"next": 4})
    os.remove(tmp_path / lost[0].name)
    assert [r[4] for p in lost for r in s.read(p)] == [True, False]
