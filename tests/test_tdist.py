"""p-values of Student's t against published values and sums of its density."""

import math

import pytest
from pyspark.sql import functions as F

from eventloom.functions.tdist import incomplete_beta, log_gamma, t_two_sided


def simpson(t, df, steps=20000):
    front = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    h = abs(t) / steps
    heights = [front * (1 + (i * h) ** 2 / df) ** (-(df + 1) / 2) for i in range(steps + 1)]
    return 1 - 2 * h / 3 * (heights[0] + heights[-1] + 4 * sum(heights[1:-1:2]) + 2 * sum(heights[2:-1:2]))


def test_p_values(spark):
    rows = [(t, df) for df in (1.0, 1.5, 2.0, 7.3, 30.0, 1000.0, 60_000.0) for t in (0.0, 0.3, -1.1, 2.5, 6.0)]
    got = spark.createDataFrame(rows, "t double, df double").select("t", "df", t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()
    for r in got:
        assert r["p"] == pytest.approx(simpson(r["t"], r["df"]), abs=1e-9)
    published = [(12.706, 1.0, 0.05), (2.228, 10.0, 0.05), (3.169, 10.0, 0.01), (1.96, 1e7, 0.05)]
    df = spark.createDataFrame(published, "t double, df double, want double")
    for r in df.select("want", t_two_sided(F.col("t"), F.col("df")).alias("p")).collect():
        assert r["p"] == pytest.approx(r["want"], rel=2e-3)


def test_odd_arguments(spark):
    rows = [(None, 3.0), (1.0, None), (float("nan"), 3.0), (float("inf"), 3.0), (1.0, 0.0), (0.0, 5.0), (1e200, 5.0)]
    df = spark.createDataFrame(rows, "t double, df double").coalesce(1)
    assert [r[0] for r in df.select(t_two_sided(F.col("t"), F.col("df"))).collect()] == [None, None, None, 0.0, None, 1.0, 0.0]


def test_parts_stay_in_the_jvm(spark):
    rows = [(0.5,), (1.0,), (7.5,), (1e5,)]
    df = spark.createDataFrame(rows, "z double")
    for r in df.select("z", log_gamma(F.col("z")).alias("g")).collect():
        assert r["g"] == pytest.approx(math.lgamma(r["z"]), abs=1e-9, rel=1e-13)
    one = spark.range(1).select(incomplete_beta(F.lit(2.0), F.lit(3.0), F.lit(0.4)).alias("v"))
    assert one.first()["v"] == pytest.approx(0.5248, abs=1e-12)
    assert "Python" not in df.select(t_two_sided(F.col("z"), F.col("z")))._jdf.queryExecution().executedPlan().toString()
