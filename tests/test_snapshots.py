"""Snapshots verified while they are written, and rows that lie on disk once."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import snapshots
from plumbline.operators.snapshots import ContentStore, SourceChanged


def test_verified_writes(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(1000).withColumn("v", F.col("id") % 7).coalesce(3).write.parquet(src)
    df = spark.read.parquet(src)
    planned = snapshots.snapshot(df)
    assert planned.rows == 1000 and snapshots.snapshot(df.orderBy(F.desc("id")).repartition(5)) == planned
    assert snapshots.write_verified(df.repartition(4), out, planned) == planned and spark.read.parquet(out).count() == 1000
    # one value changes between plan and write
    spark.range(1000).withColumn("v", F.when(F.col("id") == 5, 0).otherwise(F.col("id") % 7)).write.mode("overwrite").parquet(src)
    with pytest.raises(SourceChanged, match="other content"):
        snapshots.write_verified(spark.read.parquet(src), str(tmp_path / "bad"), planned)
    assert not (tmp_path / "bad").exists()
    assert snapshots.snapshot(df.limit(0)) == (0, 0)


def test_content_store(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path / "store"))
    text = F.sha2(F.col("id").cast("string"), 512)
    first = spark.range(3000).withColumn("text", text)
    assert store.put("t", first) == 1
    one = store.size("t")
    second = first.where("id >= 30").unionByName(spark.createDataFrame([(-1, None), (-1, None)], "id long, text string"))
    assert store.put("t", second, snapshots.snapshot(second)) == 2
    new = spark.read.parquet(str(tmp_path / "store/t/objects/2"))
    assert new.count() == 1  # unchanged rows are shared
    rows = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert rows(store.get("t")) == rows(second) and rows(store.get("t", 1)) == rows(first)
    assert store.put("u", second.limit(5)) == 1
    other = store.size("u")
    with pytest.raises(SourceChanged):
        store.put("t", first.limit(10), snapshots.snapshot(first))
    assert store.generations("t") == [1, 2]
    before, after = store.compact("t", keep=1, partitions=1)
    assert before > one and after < before and store.size("t") == after and store.size("u") == other
    assert rows(store.get("t")) == rows(second) and store.generations("t") == [2]
    with pytest.raises(LookupError):
        store.get("t", 1)
    third = second.limit(100)
    n = store.put("t", third)
    assert store.get("t", n).count() == 100 and rows(store.get("t", 2)) == rows(second)
