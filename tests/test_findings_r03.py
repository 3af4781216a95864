"""Queues, limits, sensor lines and detectors at larger sizes."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsieve.operators.alerts import rate_limit
from flowsieve.plans import queries_csv, queries_ml
from flowsieve.sources import zeek
from flowsieve.sources.csv_flows import read_exporter_csv
from flowsieve.sources.tables import flows_from_events
from flowsieve.streaming.queue import AlertQueue

from test_stream_queue_routing import alerts, feed

T0 = dt.datetime(2024, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def events(spark, n, value=lambda i: float(i * 7 % 100)):
    kinds = ["error", "signup", "view", "click", "purchase"]
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=i * 60), i % 11, kinds[i % 5], value(i)) for i in range(n)],
                                 "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


def test_all_drains_at_once_are_those_of_one_after_the_other(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "q")
    for name, seqs in (("a", range(7)), ("b", range(7, 9)), ("c", range(9, 21))):
        feed(spark, tmpdir_path, name, alerts(spark, [(i, None if i == 3 else (i * 37) % 11) for i in seqs]))
    one, step = {}, AlertQueue(spark, path, "one")
    while rows := (d := step.take(4)).rows.collect():
        one |= {r.flow_seq: d.number for r in rows}
        d.commit()
    queue = AlertQueue(spark, path, "all")
    drained = queue.take_all(4)
    assert {r.flow_seq: r.drain for r in drained.rows.collect()} == one and set(one.values()) == set(range(1, 7))
    assert queue.take_all(4).rows.count() == 21  # not committed
    drained.commit()
    assert not queue.take_all(4).rows.head(1) and not queue.take(4).rows.head(1)
    feed(spark, tmpdir_path, "d", alerts(spark, [(50, 1), (51, 0)]))
    assert {r.flow_seq: r.drain for r in AlertQueue(spark, path, "all").take_all(1).rows.collect()} == {51: 7, 50: 8}


def test_exporter_rates_of_flows_without_duration(spark, tmpdir_path):
    """fwd is 0 at ids divisible by 41, bwd at those divisible by 23."""
    flows = flows_from_events(events(spark, 950, lambda i: 0.0 if i % 943 == 0 or i == 5 else 2.0))
    queries_csv.exporter_rows(flows).write.option("header", True).csv(f"{tmpdir_path}/x")
    got = {int(r.flow_seq): r for r in read_exporter_csv(spark, f"{tmpdir_path}/x").collect()}
    assert len(got) == 950 and got[5].flow_bytes_s == got[5].flow_packets_s == float("inf")
    assert got[943].flow_bytes_s == 0.0 and got[943].flow_packets_s == 0.0  # not a number, read as 0
    assert got[6].flow_packets_s == (got[6].total_fwd_packets + got[6].total_backward_packets) * 50.0


def test_dense_scores_of_every_flow(spark, tmpdir_path, monkeypatch):
    events(spark, 400).write.parquet(f"{tmpdir_path}/events.parquet")
    monkeypatch.setattr(queries_ml, "DETECTOR_TRAINING", queries_ml.TrainConfig(epochs=1, steps=2))
    rows = queries_ml.q_dense_scores(spark, tmpdir_path).collect()
    assert sorted(r.flow_seq for r in rows) == list(range(400))
    assert all(0 <= r.prob <= 1 and r.alert == (r.prob > 0.7) and r.prediction == ("MALICIOUS" if r.alert else "BENIGN")
               and (r.severity == "CRITICAL") == (r.prob >= 0.9) for r in rows)


@pytest.mark.parametrize("keys", [None, ["k"]])
def test_limiter_sums_its_windows_and_slides_over_none(spark, keys):
    rng = np.random.default_rng(5)
    at, key = rng.integers(0, 4000, 600) / 4.0, rng.integers(0, 3, 600)
    rows = [(i, T0 + dt.timedelta(seconds=float(s)), int(k)) for i, (s, k) in enumerate(zip(at, key))]
    frame = spark.createDataFrame([*rows, rows[7]], "flow_seq long, timestamp timestamp_ntz, k long")
    out = rate_limit(frame, cap=20, window_seconds=60, key_cols=keys, method="halo")
    assert "RangeFrame, -" not in plan_of(out) and out.columns == ["flow_seq", "timestamp", "k", "window_count", "passed"]
    at, key = np.append(at, at[7]), np.append(key, key[7])
    same = (key[:, None] == key) if keys else True
    want = (same & (at <= at[:, None]) & (at > at[:, None] - 60)).sum(axis=1)
    got = out.collect()
    assert sorted((r.flow_seq, r.window_count, r.passed) for r in got) == sorted(
        (int(i), int(n), bool(n <= 20)) for i, n in zip([*range(600), 7], want))
    assert {r.flow_seq: (r.timestamp, r.k) for r in got} == {i: (t, k) for i, t, k in rows}


@pytest.mark.parametrize("kind", sorted(zeek.PARSERS))
def test_lines_are_split_once(spark, kind):
    """Conditions on the fields must not split the line again for each use."""
    lines = spark.createDataFrame([("#a\tb",), ("1.5\t" + "\t".join("-" * 15),), (None,)], "value string")
    parsed = zeek.PARSERS[kind](lines)
    assert plan_of(parsed).count("split(") <= 1 and plan_of(parsed).count("regexp_replace(") <= 1
    assert parsed.count() == 1


def test_fits_over_large_tables_use_the_cores(spark):
    from flowsieve.operators.ml import TASK_ROWS, over_tasks

    large = spark.range(0, 3 * TASK_ROWS, 1, 1)
    assert over_tasks(large).rdd.getNumPartitions() == 3 and over_tasks(large).count() == 3 * TASK_ROWS
    assert over_tasks(spark.range(0, 100, 1, 1)).rdd.getNumPartitions() == 1


def test_long_texts_are_compared_as_a_whole(spark):
    """A licence repeated to thousands of words, without a notice of its own."""
    from flowsieve.llm.licenses import LICENCES, scan_licenses

    isc = dict(LICENCES)["ISC"].lower().replace(". ", " ").replace(".", " ")
    rows = [(1, "r/LICENSE", isc * 30), (2, "r/a.c", "int main() {}"), (3, "s/b", "copyright " + "word " * 5000)]
    assert len((isc * 30).split()) > 2000
    got = {r.id: (r.license, r.origin) for r in scan_licenses(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert got == {1: ("ISC", "file"), 2: ("ISC", "inherited"), 3: (None, "none")}
