"""Rate limiter (batch and stream), splits, scaling, and stream restarts."""

import datetime as dt
import os

import numpy as np
from pyspark.sql import functions as F

from flowsieve.operators.alerts import rate_limit
from flowsieve.operators.labels import split_quotas, stratified_split
from flowsieve.operators.scale import normalize_features
from flowsieve.streaming import sinks
from flowsieve.streaming.alerts import rate_limit_query

T0 = dt.datetime(2024, 1, 1)


def _alerts(spark, offsets_s):
    rows = [(i, T0 + dt.timedelta(seconds=s)) for i, s in enumerate(offsets_s)]
    return spark.createDataFrame(rows, "flow_seq long, timestamp timestamp_ntz")


def test_burst_is_capped(spark):
    offs = [i * 0.2 for i in range(250)]                 # 250 alerts within 60 s
    out = rate_limit(_alerts(spark, offs), cap=100).orderBy("flow_seq").collect()
    passed = [r.passed for r in out]
    assert sum(passed) == 100 and all(passed[:100]) and not any(passed[100:])


def test_window_is_strictly_newer_and_ties_count_together(spark):
    offs = [0, 60, 60, 61]
    out = {r.flow_seq: r for r in rate_limit(_alerts(spark, offs), cap=2).collect()}
    assert out[1].window_count == 2          # the alert at 0 s is not newer than 60 s - 60 s
    assert out[2].window_count == 2 and out[3].window_count == 3 and not out[3].passed


def test_stream_limiter_matches_batch(spark, tmpdir_path):
    rng = np.random.default_rng(3)
    offs = np.sort(rng.uniform(0, 3 * 3600, 240))
    offs[50] = offs[49]                                  # a same-instant pair
    df = _alerts(spark, [float(x) for x in offs])
    bounds = [0, 3600, 7200, 10800]
    for i in range(3):
        part = df.where((F.col("timestamp") >= F.lit(T0 + dt.timedelta(seconds=bounds[i])))
                        & (F.col("timestamp") < F.lit(T0 + dt.timedelta(seconds=bounds[i + 1]))))
        part.coalesce(1).write.parquet(os.path.join(tmpdir_path, "in", f"p{i}"))
    stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
              .parquet(os.path.join(tmpdir_path, "in", "p*", "*.parquet")))
    got = _limit_stream(spark, stream, tmpdir_path, cap=5, window_seconds=600)
    want = _decisions(rate_limit(df, cap=5, window_seconds=600))
    assert got == want and 0 < sum(p for _, p in got.values()) < len(got)


def _decisions(df):
    return {r.flow_seq: (r.window_count, r.passed) for r in df.collect()}


def _limit_stream(spark, stream, folder, **limits):
    attempts, out, ck = (os.path.join(folder, x) for x in ("attempts", "out", "ck"))
    rate_limit_query(stream, attempts, out, ck, **limits).awaitTermination()
    return _decisions(sinks.latest_snapshot(spark, out, ["flow_seq"]))


def test_stream_limiter_with_many_unsorted_rows_per_key(spark, tmpdir_path):
    """30,000 shuffled alerts of two keys in one trigger, in one file."""
    rng = np.random.default_rng(5)
    n = 30_000
    offs = rng.uniform(0, 4 * 3600, n).round(2)
    rows = [(i, "ab"[i % 3 == 0], T0 + dt.timedelta(seconds=float(s))) for i, s in enumerate(offs)]
    df = spark.createDataFrame(rows, "flow_seq long, src_ip string, timestamp timestamp_ntz")
    src = os.path.join(tmpdir_path, "in")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    limits = dict(cap=100, window_seconds=60, key_cols=["src_ip"])
    got = _limit_stream(spark, stream, tmpdir_path, **limits)
    want = _decisions(rate_limit(df, **limits))
    assert got == want and 0 < sum(p for _, p in got.values()) < n


def test_stream_limiter_with_a_late_file(spark, tmpdir_path):
    """The oldest alerts arrive last; every decision ends as in batch."""
    rng = np.random.default_rng(6)
    offs = np.sort(rng.uniform(0, 3600, 300))
    df = _alerts(spark, [float(x) for x in offs])
    src = os.path.join(tmpdir_path, "in")
    parts = ["flow_seq % 3 = 0", "flow_seq % 3 = 1", "flow_seq % 3 = 2"]
    schema, limits = df.schema, dict(cap=6, window_seconds=120)
    got = None
    for i, cond in enumerate(reversed(parts)):
        df.where(cond).coalesce(1).write.parquet(os.path.join(src, f"p{i}"))
        stream = spark.readStream.schema(schema).parquet(os.path.join(src, "p*", "*.parquet"))
        got = _limit_stream(spark, stream, tmpdir_path, **limits)     # resumes from its checkpoint
    assert got == _decisions(rate_limit(df, **limits))


def test_replayed_snapshot_replaces_itself(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "snap")
    for _ in range(2):
        sinks.write_batch(spark.createDataFrame([(1,)], "n int"), path, 0)
    assert sinks.latest_snapshot(spark, path).count() == 1


def test_append_new_rows_keeps_late_rows_once(spark, tmpdir_path):
    src, out, ck = (os.path.join(tmpdir_path, x) for x in ("src", "out", "ck"))
    df = _alerts(spark, [0, 86400 * 3, 10, 10 + 86400 * 3])
    for i, ids in enumerate([(1, 3), (1, 0), (0, 2, 2)]):              # late rows, repeats across and inside triggers
        part = df.where(F.col("flow_seq").isin(*ids))
        part = part.unionByName(df.where(F.col("flow_seq") == 2)) if i == 2 else part
        part.coalesce(1).write.parquet(os.path.join(src, f"p{i}"))
        stream = spark.readStream.schema(df.schema).parquet(os.path.join(src, "p*", "*.parquet"))
        sinks.append_new_rows(stream, out, ck, ["flow_seq"], "timestamp").awaitTermination()
    assert sorted(r.flow_seq for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]


def test_split_keeps_rows_without_a_class(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else "xy"[i % 2]) for i in range(70)], "k long, y string")
    out = stratified_split(df, "y", "k", 0.2, 1)
    assert out.count() == 70 and out.where("y is null and is_test").count() == 2


def test_stream_restart_reads_new_files_once(spark, tmpdir_path):
    src, out, ck = (os.path.join(tmpdir_path, x) for x in ("src", "out", "ck"))
    df = spark.range(30).withColumn("v", F.col("id") * 2)
    df.where("id < 10").coalesce(1).write.parquet(os.path.join(src, "a"))
    df.where("id >= 10 AND id < 20").coalesce(1).write.parquet(os.path.join(src, "b"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(src, "*", "*.parquet"))
    sinks.append_table(stream, out, ck).awaitTermination()
    assert spark.read.parquet(out).count() == 20
    df.where("id >= 20").coalesce(1).write.parquet(os.path.join(src, "c"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(src, "*", "*.parquet"))
    sinks.append_table(stream, out, ck).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 30 and got.select("id").distinct().count() == 30


def test_drain_after_high_water_mark(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "alerts")
    _alerts(spark, list(range(20))).write.parquet(path)
    first = sinks.drain(spark, path, None, 5).collect()
    nxt = sinks.drain(spark, path, (first[-1].timestamp, first[-1].flow_seq), 5).collect()
    assert [r.flow_seq for r in first] == [0, 1, 2, 3, 4] and [r.flow_seq for r in nxt] == [5, 6, 7, 8, 9]


def test_stratified_split_exact_sizes(spark):
    df = spark.createDataFrame([(i, 1 if i % 7 == 0 else 0) for i in range(1000)], "k long, y int")
    out = stratified_split(df, "y", "k", 0.2, 42)
    counts = {(r.y, r.is_test): r["count"] for r in out.groupBy("y", "is_test").count().collect()}
    quotas = split_quotas({0: 857, 1: 143}, 0.2)
    assert counts[(0, True)] == quotas[0] and counts[(1, True)] == quotas[1]
    assert quotas[0] + quotas[1] == 200


def test_scaler_mean_zero_pop_std_one(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(x), 5.0) for x in rng.normal(3, 2, 300)], "a double, c double")
    out, fit = normalize_features(df, ["a", "c"])
    r = out.agg(F.avg("a"), F.stddev_pop("a"), F.max(F.abs("c"))).collect()[0]
    assert abs(r[0]) < 1e-9 and abs(r[1] - 1) < 1e-9 and r[2] == 0.0


def test_prefix_and_halo_limiters_agree_with_hot_key(spark):
    rng = np.random.default_rng(11)
    n = 600
    keys = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    offs = np.sort(rng.uniform(0, 7200, n)).round(3)
    offs[10] = offs[9]                                   # same-instant pair
    rows = [(i, str(k), T0 + dt.timedelta(seconds=float(s))) for i, (k, s) in enumerate(zip(keys, offs))]
    df = spark.createDataFrame(rows, "flow_seq long, src_ip string, timestamp timestamp_ntz")
    a = {r.flow_seq: (r.window_count, r.passed)
         for r in rate_limit(df, cap=8, window_seconds=300, key_cols=["src_ip"]).collect()}
    b = {r.flow_seq: (r.window_count, r.passed)
         for r in rate_limit(df, cap=8, window_seconds=300, key_cols=["src_ip"], method="halo").collect()}
    assert a == b and len(a) == n
    assert 0 < sum(p for _, p in a.values()) < n
