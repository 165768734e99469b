import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import severity as s


def test_formulas(spark):
    df = spark.createDataFrame([(0.0,), (3.0,), (20.0,), (40.0,)], "v double")
    got = df.select(s.binary(F.col("v")), s.log_count(F.col("v")), s.linear_over_threshold(F.col("v"), 20), s.log_ratio(F.col("v"), 20), s.continuous_log(F.col("v"), 0, 15)).collect()
    want = [(0, 0, 0, 0, 0), (1, 2, 0, 0, math.log2(1.2)), (1, math.log2(21), 1, 1, math.log2(1 + 20 / 15)), (1, math.log2(41), 2, 2, math.log2(1 + 40 / 15))]
    assert all(tuple(g) == pytest.approx(w) for g, w in zip(got, want))
    with pytest.raises(ValueError):
        s.continuous_log(F.col("v"), 10, 10)


def test_god_class_gates(spark):
    df = spark.createDataFrame([(46.0, 6.0, 10.0), (47.0, 5.0, 10.0), (47.0, 6.0, 34.0), (47.0, 10.0, 100 / 6)], "w double, a double, t double")
    got = [r[0] for r in df.select(s.god_class(F.col("w"), F.col("a"), F.col("t"))).collect()]
    assert got[:3] == [0, 0, 0] and got[3] == pytest.approx(30 + 16 + 16)


def test_rounding_and_display(spark):
    df = spark.createDataFrame([(0.1234567890125,), (1.5e7,), (-2.5,)], "v double")
    got = df.select(s.exact(F.col("v")), s.display_number(F.col("v"))).collect()
    assert got[0][0] == pytest.approx(0.123456789013, abs=1e-13) and got[1][0] == 1.5e7 and got[2][0] == -2.5
    assert [r[1] for r in got] == ["0.123457", "15000000", "-2.5"]


def test_checked_refuses(spark):
    df = spark.createDataFrame([(float("nan"),)], "v double")
    with pytest.raises(Exception, match="finite"):
        df.select(s.checked(F.col("v"), "x")).collect()
