"""Window features against pandas' rolling functions on the same rows
(trailing row frames, at least one row, missing filled with 0)."""

import numpy as np
import pandas as pd
import pytest

from flowsieve.operators.rolling import rolling_features


@pytest.mark.parametrize("scale", [40, 70_000, 5_000_000])
def test_rolling_matches_pandas(spark, scale):
    rng = np.random.default_rng(scale)
    n = 400
    x = rng.integers(0, scale, n).astype("int64")
    x[100:112] = 7                                     # a constant stretch
    pdf = pd.DataFrame({"seq": np.arange(n, dtype="int64"), "x": x})
    out = (rolling_features(spark.createDataFrame(pdf), ["x"], "seq",
                            kinds=("var_std", "skew_kurt", "quantiles", "mean_std"), bucket_rows=37)
           .toPandas().sort_values("seq").reset_index(drop=True))
    s = pdf["x"].astype(float)
    want = {
        "x_variance": s.rolling(5, min_periods=1).var(),
        "x_std": s.rolling(5, min_periods=1).std(),
        "x_skewness": s.rolling(10, min_periods=1).skew(),
        "x_kurtosis": s.rolling(10, min_periods=1).kurt(),
        "x_q25": s.rolling(10, min_periods=1).quantile(0.25),
        "x_q75": s.rolling(10, min_periods=1).quantile(0.75),
        "x_rolling_mean_20": s.rolling(20, min_periods=1).mean(),
        "x_rolling_std_10": s.rolling(10, min_periods=1).std(),
    }
    for col, ref in want.items():
        ref = ref.fillna(0).to_numpy()
        got = out[col].to_numpy()
        assert np.allclose(got, ref, rtol=1e-7, atol=1e-6 * max(1.0, float(np.abs(ref).max()))), col
