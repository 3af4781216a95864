"""Nearest-neighbour mutual information against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators.neighbors import digamma, neighbor_mutual_info


def psi(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, n))


def brute(rows, k=3):
    """rows: (value, class). Every pair of rows is looked at."""
    rows = [(v, y) for v, y in rows if v is not None and y is not None and math.isfinite(v)]
    size = {y: sum(c == y for _, c in rows) for _, y in rows}
    rows = [r for r in rows if size[r[1]] > 1]
    if not rows:
        return 0.0
    x, cls = np.array([v for v, _ in rows]), np.array([y for _, y in rows])
    total = 0.0
    for i, (v, y) in enumerate(rows):
        own = np.delete(np.abs(x - v), i)[np.delete(cls, i) == y]
        kk = min(k, len(own))
        r = np.sort(own)[kk - 1]
        m = int((x == v).sum() if r == 0 else ((x > v - r) & (x < v + r)).sum())
        total += psi(kk) - psi(size[y]) - psi(m)
    return max(0.0, psi(len(rows)) + total / len(rows))


def test_digamma(spark):
    got = [r.p for r in spark.range(1, 400).select(digamma(F.col("id")).alias("p")).collect()]
    assert np.allclose(got, [psi(n) for n in range(1, 400)], atol=1e-11)


@pytest.mark.parametrize("k,bucket_rows", [(1, 17), (3, 17), (3, None), (5, 41)])
def test_equals_brute_force(spark, k, bucket_rows):
    rng = random.Random(k)
    rows = []
    for i in range(2000 if k == 3 else 400):
        y = rng.choice(["a", "b", "b", None]) if i % 50 else f"rare{i % 200}"
        shift = 2.0 if y == "b" else 0.0
        rows.append((rng.gauss(shift, 1), float(rng.randrange(6) + shift), 5.0 if rng.random() < 0.7 else rng.random(), None if i % 3 else
                     [float("nan"), float("inf"), -0.0, 0.0, 1.5][i % 5], y))
    names = ["smooth", "ties", "hot", "holes"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names) + ", y string").repartition(5)
    got = {r.feature: r.mi for r in neighbor_mutual_info(df, names, "y", k, bucket_rows).collect()}
    want = {c: brute([(r[j], r[4]) for r in rows], k) for j, c in enumerate(names)}
    assert got == pytest.approx(want, abs=1e-9) and want["smooth"] > 0.1


def test_a_hot_value_is_one_row_of_the_rest(spark):
    """Two thirds of the rows have one value; what is windowed are distinct values."""
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, 7.0).otherwise(F.col("id") * 0.5).alias("x"), (F.col("id") % 2).alias("y"))
    got = neighbor_mutual_info(df, ["x"], "y").first()
    assert 0 <= got.mi < 0.05 and got["rank"] == 1


def test_empty_and_lonely_rows(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "a")], "x double, y string")
    for rows in (df, df.limit(0)):
        assert [tuple(r) for r in neighbor_mutual_info(rows, ["x"], "y").collect()] == [("x", 0.0, 1)]


def test_ranks_informative_features_first(spark):
    rng = random.Random(9)
    rows = [(float(y) + rng.gauss(0, 0.3), rng.random(), y) for y in [rng.randrange(2) for _ in range(1500)]]
    got = neighbor_mutual_info(spark.createDataFrame(rows, "good double, noise double, y int"), ["noise", "good"], "y").collect()
    assert {r.feature: r["rank"] for r in got} == {"good": 1, "noise": 2}
