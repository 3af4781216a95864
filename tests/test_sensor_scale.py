"""Sensor logs of a large table: every core renders lines, each input is passed over once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowsieve.plans import fixture_lines, queries_sources
from flowsieve.plans.registry import spark_queries


@pytest.fixture()
def sf_dir(spark, tmpdir_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i % 11, "view", i / 4) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.coalesce(1).write.parquet(f"{tmpdir_path}/events.parquet")     # one row group, as tables of a million rows have
    return tmpdir_path


@pytest.mark.parametrize("name,kinds", [("conn_parse", 1), ("conn_header_parse", 1), ("zeek_union", 5)])
def test_every_core_renders(spark, sf_dir, monkeypatch, name, kinds):
    seen = []

    def counted(render):
        def run(flows):
            seen.append(flows.select("flow_seq").rdd.getNumPartitions())
            return render(flows)
        return run
    monkeypatch.setattr(queries_sources, "spread", lambda spark, df: df.repartition(7))
    monkeypatch.setattr(queries_sources, "RENDERERS", {k: counted(r) for k, r in queries_sources.RENDERERS.items()})
    got = spark_queries()[name](spark, sf_dir)
    assert len(seen) == kinds and min(seen) >= 4      # the cores of the test session
    uids = {r.zeek_uid for r in got.select("zeek_uid").distinct().collect() if r.zeek_uid.startswith("C")}
    assert uids == {f"C{i}" for i in range(1, 300) if i % 83}


def test_bad_records_in_one_pass(spark):
    lines = spark.createDataFrame([(5, "1.0\ta\tb\t7\tc"), (6, "1.0\ta"), (102, "#comment\t102"), (None, "x")], "flow_seq long, value string")
    out = queries_sources.with_bad_records(lines, "conn")
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.collectLeaves().size() == 1
    spoiled = [f"{v}\ta\tb\t7\tc" for v in queries_sources.BAD_EPOCHS] + [f"1.0\ta\tb\t{v}\tc" for v in queries_sources.BAD_PORTS]
    assert sorted(r.value for r in out.collect()) == sorted(["1.0\ta\tb\t7\tc", "1.0\ta", "#comment\t102", "x", *spoiled])


def test_seconds_as_formatted(spark):
    us = [0, 5, 999_999, 1_000_000, 1_704_067_200_000_007, -1, -5_000_001, None]
    df = spark.createDataFrame([(u,) for u in us], "us long")
    old = F.format_string("%d.%06d", F.floor(F.col("us") / 1000000).cast("bigint"), F.col("us") % 1000000)
    assert all(r.a == r.b for r in df.select(fixture_lines.micros_text(F.col("us")).alias("a"), old.alias("b")).collect())
