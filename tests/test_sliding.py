"""Trailing-window statistics in one pass over the rows."""

from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowsieve.operators.rolling import rolling_features
from flowsieve.plans import pipelines

KINDS = ("var_std", "skew_kurt", "quantiles", "mean_std")


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture()
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def rows(spark, n=400):
    values = [(i, None if i % 60 < 25 else "ab"[i % 2], None if i % 13 in (3, 4) or 200 <= i < 215 else (i * 7919 % 1000) / 7.0) for i in range(n)]
    values[50:64] = [(i, None, 2.5) for i in range(50, 64)]
    return spark.createDataFrame(values, "seq long, k string, x double")


def test_every_frame_is_that_of_a_spark_window(spark, small_batches):
    df = rows(spark)
    got = rolling_features(df, ["x"], "seq", KINDS, ["k"], bucket_rows=160)
    assert "Window" not in plan_of(got)               # no aggregate evaluated anew over each frame
    w = Window.partitionBy("k").orderBy("seq")

    def over(f, n):
        return F.coalesce(f(F.col("x")).over(w.rowsBetween(1 - n, 0)), F.lit(0.0))
    want = df.select("seq", over(F.var_samp, 5).alias("x_variance"), over(F.stddev_samp, 20).alias("x_rolling_std_20"),
                     over(F.avg, 10).alias("x_rolling_mean_10"), F.skewness("x").over(w.rowsBetween(-9, 0)).alias("g1"),
                     F.count("x").over(w.rowsBetween(-9, 0)).alias("n"), F.min("x").over(w.rowsBetween(-9, 0)).alias("lo"),
                     F.max("x").over(w.rowsBetween(-9, 0)).alias("hi"))
    old = {r.seq: r for r in want.collect()}
    new = {r.seq: r for r in got.collect()}
    assert len(new) == len(old) == 400
    for seq, a in old.items():
        b = new[seq]
        assert all(a[c] == b[c] for c in ("x_variance", "x_rolling_std_20", "x_rolling_mean_10")), seq
        n = a.n
        skew = 0.0 if n < 3 or a.lo == a.hi else a.g1 * (n * (n - 1)) ** 0.5 / (n - 2)
        assert b.x_skewness == pytest.approx(skew, rel=1e-14)
        assert b.x_kurtosis == (0.0 if n < 4 else -3.0) or (n >= 4 and a.lo != a.hi)


@pytest.mark.parametrize("width", [3, 60_000, 15_000_000, 10**12])
def test_whole_numbers_of_any_width(spark, small_batches, width):
    """Exact in 64 bits, in Python integers, and the moments of doubles beyond."""
    x = [None if i % 17 == 5 else 10**15 + (i * 104729 * 7919) % width for i in range(120)]
    got = rolling_features(spark.createDataFrame([*enumerate(x)], "seq long, x long"), ["x"], "seq", KINDS).orderBy("seq").collect()
    for i, r in enumerate(got):
        f = [Fraction(v) for v in x[max(0, i - 9):i + 1] if v is not None]
        n, mean = len(f), sum(f) / max(len(f), 1)
        m2, m3, m4 = (sum((v - mean) ** k for v in f) / max(n, 1) for k in (2, 3, 4))
        five = [Fraction(v) for v in x[max(0, i - 4):i + 1] if v is not None]
        var = sum((v - sum(five) / len(five)) ** 2 for v in five) / (len(five) - 1) if len(five) > 1 else 0
        assert r.x_variance == pytest.approx(float(var), rel=1e-12)
        if n >= 4 and m2:
            g2 = float(m4 / m2 ** 2 - 3)
            assert r.x_kurtosis == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), rel=1e-9, abs=1e-9)
            g1 = float(m3) / float(m2) ** 1.5
            assert r.x_skewness == pytest.approx(g1 * (n * (n - 1)) ** 0.5 / (n - 2), rel=1e-9, abs=1e-9)


def test_engineered_columns_take_one_pass(spark, monkeypatch):
    plans = []

    def seen(df, name, keep=pipelines.written):
        plans.append(plan_of(df))
        return keep(df, name)
    monkeypatch.setattr(pipelines, "written", seen)
    df = spark.createDataFrame([(i, i % 7, i / 3, "TCP", "BENIGN") for i in range(60)],
                               "flow_seq long, total_fwd_packets long, flow_duration double, protocol string, label string")
    res = pipelines.engineer_all_features(df, "flow_seq")
    assert len(plans) == 1 and "Window" not in plans[0] and res.frame.count() == 60
