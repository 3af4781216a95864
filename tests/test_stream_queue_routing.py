"""Queues drained by arrival, reject routing, observed counters, keyed state."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators.alerts import rate_limit
from flowsieve.streaming import routing
from flowsieve.streaming.keyed import decide, limit_by_key
from flowsieve.streaming.queue import AlertQueue, enqueue

T0 = dt.datetime(2024, 1, 1)


def alerts(spark, rows):
    """rows: (seq, seconds or None)."""
    return spark.createDataFrame([(i, None if s is None else T0 + dt.timedelta(seconds=s)) for i, s in rows],
                                 "flow_seq long, timestamp timestamp_ntz")


def feed(spark, folder, name, frame):
    frame.coalesce(1).write.parquet(os.path.join(folder, "in", name))
    stream = spark.readStream.schema(frame.schema).parquet(os.path.join(folder, "in", "*", "*.parquet"))
    enqueue(stream, os.path.join(folder, "q"), os.path.join(folder, "ck")).awaitTermination()


def test_a_late_alert_is_drained_once_also_after_a_restart(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "q")
    feed(spark, tmpdir_path, "a", alerts(spark, [(1, 100), (2, 200), (3, 300)]))
    first = AlertQueue(spark, path).take()
    assert [r.flow_seq for r in first.rows.collect()] == [1, 2, 3]
    first.commit()
    assert AlertQueue(spark, path).take().rows.count() == 0
    feed(spark, tmpdir_path, "b", alerts(spark, [(4, 50), (5, None), (6, 400)]))  # times before the mark, and none
    again = AlertQueue(spark, path).take()  # a new consumer object reads the saved mark
    assert [r.flow_seq for r in again.rows.collect()] == [5, 4, 6]
    assert [r.flow_seq for r in AlertQueue(spark, path).take().rows.collect()] == [5, 4, 6]  # not committed
    again.commit()
    assert AlertQueue(spark, path).take().rows.count() == 0


def test_bounded_drains_cover_the_queue_and_consumers_are_apart(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "q")
    for name, seqs in (("a", range(7)), ("b", range(7, 9)), ("c", range(9, 20))):
        feed(spark, tmpdir_path, name, alerts(spark, [(i, (i * 37) % 11) for i in seqs]))
    queue, seen = AlertQueue(spark, path), []
    while len(rows := (d := queue.take(4)).rows.collect()):
        assert len(rows) <= 4
        seen += [r.flow_seq for r in rows]
        d.commit()
    order = sorted(range(20), key=lambda i: (0 if i < 7 else 1 if i < 9 else 2, (i * 37) % 11, i))
    assert seen == order
    assert AlertQueue(spark, path, "other").take(100).rows.count() == 20
    assert queue.release() == 2 and queue.take().rows.count() == 0
    feed(spark, tmpdir_path, "d", alerts(spark, [(50, 1)]))
    assert [r.flow_seq for r in queue.take().rows.collect()] == [50]


def test_an_empty_queue(spark, tmpdir_path):
    drained = AlertQueue(spark, os.path.join(tmpdir_path, "none")).take()
    assert drained.rows.count() == 0
    drained.commit()
    assert AlertQueue(spark, os.path.join(tmpdir_path, "none")).release() == 0


RECORDS = [(1, "10.0.0.1", "10.0.0.2", "80", "443", "5"), (2, None, "10.0.0.2", "80", "443", "5"), (3, "10.0.0.1", "10.0.0.2", "80", None, "5"),
           (4, "10.0.0.1", "10.0.0.2", "x", "443", "5"), (5, "10.0.0.1", "10.0.0.2", "80", "443", "abc"), (6, "300.0.0.1", "10.0.0.2", "80", "443", None),
           (7, "10.0.0.1", "nowhere", "80", "443", "5"), (8, "::1", "10.0.0.2", "80", "443", None), (9, "1", "2", "x", None, "abc")]
REASONS = {1: None, 2: "missing src_ip", 3: "missing dst_port", 4: "bad src_port", 5: "bad flow_duration", 6: "bad address src_ip",
           7: "bad address dst_ip", 8: None, 9: "bad src_port"}


def test_records_are_routed_with_their_reason(spark, tmpdir_path):
    raw = spark.createDataFrame(RECORDS, "flow_seq long, src_ip string, dst_ip string, src_port string, dst_port string, flow_duration string")
    for i in range(3):
        raw.where(f"flow_seq % 3 = {i}").coalesce(1).write.parquet(os.path.join(tmpdir_path, "in", str(i)))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(tmpdir_path, "in", "*", "*.parquet"))
    out = os.path.join(tmpdir_path, "out")
    routing.route_records(stream, out, os.path.join(tmpdir_path, "ck")).awaitTermination()
    rejected = routing.rejected_records(spark, out)
    assert {r.flow_seq: r.reject_reason for r in rejected.collect()} == {k: v for k, v in REASONS.items() if v}
    assert set(raw.columns) <= set(rejected.columns) and rejected.where("flow_seq = 4").first().src_port == "x"
    assert sorted(r.flow_seq for r in routing.accepted_flows(spark, out, ["flow_seq"]).collect()) == [1, 8]
    counts = spark.read.parquet(out + "_counts").agg(F.sum("records"), F.sum("good"), F.sum("rejected"), F.count("*")).first()
    assert tuple(counts) == (9, 2, 7, 3)


def test_counters_go_on_after_a_restart(spark, tmpdir_path):
    scored = spark.range(30).select("id", F.when(F.col("id") % 3 == 0, "MALICIOUS").otherwise("BENIGN").alias("prediction"),
                                    (F.col("id") % 6 == 0).alias("alert"))
    out, ck = (os.path.join(tmpdir_path, x) for x in ("out", "ck"))
    assert routing.counter_snapshot(spark, out).first().total_flows_processed == 0
    for i, now in enumerate((100.0, 104.0, 110.0)):
        scored.where(f"id % 3 = {i}" if i < 2 else "id % 3 = 2 or id < 0").coalesce(1).write.parquet(os.path.join(tmpdir_path, "in", str(i)))
        stream = spark.readStream.schema(scored.schema).parquet(os.path.join(tmpdir_path, "in", "*", "*.parquet"))
        routing.counted_alerts(stream, out, ck, "zeek", clock=lambda: now).awaitTermination()
    got = routing.counter_snapshot(spark, out).first()
    assert (got.total_flows_processed, got.malicious_flows, got.benign_flows, got.alerts_generated) == (30, 10, 20, 5)
    assert got.uptime_seconds == 10.0 and got.flows_per_second == 3.0 and got.data_source == "zeek"
    assert got.detection_rate == pytest.approx(100 / 3) and got.alert_rate == pytest.approx(100 / 6)


def test_remembered_times_are_bounded_and_enough():
    rng = np.random.default_rng(1)
    times = np.sort(rng.integers(0, 2000, 400))
    state, got = [], []
    for part in np.split(times, [7, 8, 100, 260]):
        count, state = decide(part, state, 5, 60)
        got += count.tolist()
        assert len(state) <= 6
    # attempts of one instant that are split over two batches are the only ones that could differ
    want = [min(int(((times > t - 60) & (times <= t)).sum()), 6) for t in times]
    assert sum(a != b for a, b in zip(got, want)) <= 4


def test_keyed_limiter_equals_the_batch_limiter_and_restarts(spark, tmpdir_path):
    rng = np.random.default_rng(2)
    rows = [(i, ["a", "a", "b", None][int(rng.integers(4))], T0 + dt.timedelta(seconds=float(s)))
            for i, s in enumerate(np.sort(rng.uniform(0, 5000, 500)).round(2))]
    df = spark.createDataFrame(rows, "flow_seq long, src_ip string, timestamp timestamp_ntz")
    out, ck = (os.path.join(tmpdir_path, x) for x in ("out", "ck"))
    for i in range(4):  # a query of its own each: state comes back from the checkpoint
        df.where(f"flow_seq >= {i * 125} and flow_seq < {(i + 1) * 125}").repartition(3).write.parquet(os.path.join(tmpdir_path, "in", str(i)))
        stream = spark.readStream.schema(df.schema).parquet(os.path.join(tmpdir_path, "in", "*", "*.parquet"))
        query = limit_by_key(stream, ["src_ip"], cap=4, window_seconds=60, watermark="1 second").writeStream.format("parquet").option(
            "path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        query.awaitTermination()
    want = rate_limit(df.withColumn("src_ip", F.coalesce("src_ip", F.lit("none"))), cap=4, window_seconds=60, key_cols=["src_ip"])
    want = {r.flow_seq: (min(r.window_count, 5), r.passed) for r in want.collect()}
    got = {r.flow_seq: (r.window_count, r.passed) for r in spark.read.parquet(out).collect()}
    assert got == want and {p for _, p in got.values()} == {True, False}
