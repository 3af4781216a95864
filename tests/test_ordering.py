"""Distributed order helpers equal their single-partition definitions."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowsieve.operators.ordering import dense_index, ordered_window, running_totals, trailing
from flowsieve.operators.rolling import rolling_features
from flowsieve.operators.stats import exact_medians


def _frame(spark, n=500, keys=3, seed=7):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"seq": rng.permutation(n).astype("int64") * 3,
                        "k": rng.integers(0, keys, n).astype("int64"),
                        "x": rng.integers(0, 1000, n).astype("int64"),
                        "d": rng.normal(0, 10, n)})
    return spark.createDataFrame(pdf), pdf


def test_dense_index_is_rank(spark):
    df, pdf = _frame(spark)
    got = dense_index(df, ["seq"], num_partitions=5).toPandas().sort_values("seq")
    assert list(got["_idx"]) == list(range(len(pdf)))


def test_halo_window_equals_global_window(spark):
    df, _ = _frame(spark)
    out = rolling_features(df, ["x", "d"], "seq", kinds=("var_std", "skew_kurt", "quantiles", "mean_std"),
                           bucket_rows=23)
    w = Window.orderBy("seq")
    ref = df.select("seq", F.avg("x").over(trailing(w, 5)).alias("m5"),
                    F.var_samp("d").over(trailing(w, 5)).alias("v5"),
                    F.percentile("x", 0.25).over(trailing(w, 10)).alias("q25"),
                    F.avg("d").over(trailing(w, 20)).alias("m20"))
    j = out.join(ref, "seq").toPandas()
    assert len(j) == 500
    assert np.allclose(j["x_rolling_mean_5"], j["m5"])
    assert np.allclose(j["d_variance"], j["v5"].fillna(0))
    assert np.allclose(j["x_q25"], j["q25"])
    assert np.allclose(j["d_rolling_mean_20"], j["m20"])


def test_partitioned_halo_splits_hot_key(spark):
    df, _ = _frame(spark, keys=2)

    def build(w):
        return [F.sum("x").over(trailing(w, 4)).alias("s4")]

    out = ordered_window(df, "seq", ["k"], 19, build, bucket_rows=20).toPandas()
    ref = df.select("seq", F.sum("x").over(trailing(Window.partitionBy("k").orderBy("seq"), 4)).alias("r")
                    ).toPandas()
    j = out.merge(ref, on="seq")
    assert (j["s4"] == j["r"]).all()


def test_running_totals_small_buckets(spark):
    df, pdf = _frame(spark)
    out = running_totals(df, ["seq"], {"cx": F.col("x")}, bucket_rows=17).toPandas().sort_values("seq")
    assert list(out["cx"]) == list(pdf.sort_values("seq")["x"].cumsum())


def test_exact_medians_with_missing_and_ties(spark):
    vals = [1.0, 2.0, 2.0, None, float("nan"), float("inf"), 7.0, 3.0]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(vals)], "a double, b long")
    fit = exact_medians(df, ["a", "b"])
    assert fit.medians["a"] == 2.0          # finite values 1,2,2,3,7
    assert fit.medians["b"] == 3.5
    assert fit.missing["a"] == 3


def test_exact_medians_bracket_path(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=2001)
    df = spark.createDataFrame([(float(v),) for v in x], "a double")
    fit = exact_medians(df, ["a"], accuracy=50)   # coarse sketch: wide bracket
    assert fit.medians["a"] == float(np.median(x))


def test_exact_median_with_a_dominant_value(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.full(800, 5.0), rng.normal(0, 10, 1201)])
    df = spark.createDataFrame([(float(v),) for v in x], "a double")
    assert exact_medians(df, ["a"], accuracy=100).medians["a"] == float(np.median(x))


def test_dense_index_with_hot_key_over_many_partitions(spark):
    rng = np.random.default_rng(9)
    n = 900
    keys = np.where(rng.random(n) < 0.6, 0, rng.integers(1, 5, n)).astype("int64")
    pdf = pd.DataFrame({"k": keys, "seq": rng.permutation(n).astype("int64")})
    got = dense_index(spark.createDataFrame(pdf), ["k", "seq"], num_partitions=7).toPandas()
    want = pdf.sort_values(["k", "seq"]).reset_index(drop=True)
    got = got.sort_values("_idx").reset_index(drop=True)
    assert list(got["_idx"]) == list(range(n))
    assert (got[["k", "seq"]].to_numpy() == want[["k", "seq"]].to_numpy()).all()
