"""Exact medians however narrow the sketch must be."""

import numpy as np
import pytest

from flowsieve.operators.stats import exact_medians


@pytest.mark.parametrize("inside", [1_000_000, 200, 3])
def test_brackets_narrow_without_losing_the_middle(spark, inside):
    rng = np.random.default_rng(4)
    n = 4000
    cols = {"u": rng.uniform(-5, 5, n), "ties": rng.integers(0, 4, n) * 1.0, "heavy": np.where(rng.random(n) < 0.6, 7.0, rng.normal(0, 9, n)),
            "wide": rng.normal(0, 1, n) * 10.0 ** rng.integers(-9, 9, n)}
    df = spark.createDataFrame([tuple(float(x) for x in r) for r in zip(*cols.values())], ", ".join(f"{c} double" for c in cols))
    got = exact_medians(df, list(cols), accuracy=50, inside_rows=inside).medians
    assert got == {c: pytest.approx(float(np.median(v)), rel=1e-15) for c, v in cols.items()}
