"""Readers for the driver tables and the flow view derived from them.

The flow view turns each ``events`` row into one network-flow record with
integer arithmetic only, so the same numbers come out of Spark and of any
SQL engine. Derived inputs (dirty rows, rendered sensor lines, scores) are
plain projections of that view; their size grows with ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def flow_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow record per ``events`` row (see FIXTURES.md section 2)."""
    ev = read_table(spark, sf_dir, "events")
    return flows_from_events(ev)


def flows_from_events(ev: DataFrame) -> DataFrame:
    eid, uid = F.col("event_id"), F.col("user_id")
    et, v = F.col("event_type"), F.col("value")
    fwd = (eid * 13) % 41
    bwd = (eid * 17) % 23
    dst_port = (F.when(et == "view", 80).when(et == "click", 443)
                .when(et == "signup", 22).when(et == "purchase", 8080)
                .otherwise((eid * 104729) % 65536))
    protocol = (F.when(eid % 3 == 0, "TCP").when(eid % 3 == 1, "UDP").otherwise("ICMP"))
    label = (F.when((et == "error") & (v >= 50), "DDoS")
             .when((et == "error") & (v >= 20), "PortScan")
             .when((et == "signup") & (v < 5), " bruteforce ")
             .otherwise("BENIGN"))
    return ev.select(
        eid.alias("flow_seq"),
        F.col("ts").alias("flow_ts"),
        F.concat(F.lit("10.0."), _s(uid % 4), F.lit("."), _s(uid % 250)).alias("src_ip"),
        F.concat(F.lit("192.168."), _s(eid % 8), F.lit("."), _s((eid * 31) % 250)).alias("dst_ip"),
        ((eid * 7919) % 65536).cast("int").alias("src_port"),
        dst_port.cast("int").alias("dst_port"),
        protocol.alias("protocol"),
        F.round(v * 10000).alias("flow_duration"),
        fwd.alias("total_fwd_packets"),
        bwd.alias("total_backward_packets"),
        (fwd * 60).alias("total_length_fwd_packets"),
        (bwd * 52).alias("total_length_bwd_packets"),
        F.round(v * 100).alias("flow_iat_mean"),
        F.round(v * 37).alias("flow_iat_std"),
        F.when(eid % 10 == 0, 1).otherwise(0).alias("fwd_psh_flags"),
        F.when(eid % 20 == 7, 1).otherwise(0).alias("fwd_urg_flags"),
        label.alias("label"),
    )


def dirty_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow view with NULL and +Inf durations and repeated rows."""
    fl = flow_view(spark, sf_dir)
    seq = F.col("flow_seq")
    dur = (F.when(seq % 97 == 0, F.lit(None).cast("double"))
           .when(seq % 101 == 0, F.lit(float("inf")))
           .otherwise(F.col("flow_duration")))
    base = fl.withColumn("flow_duration", dur)
    return base.unionByName(base.where(seq % 50 == 0))


def score_column(seq: Column) -> Column:
    """Deterministic stand-in model score in [0, 1)."""
    return ((seq * 37) % 1000) / F.lit(1000.0)


def scored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fl = flow_view(spark, sf_dir)
    return fl.withColumn("score", score_column(F.col("flow_seq")))
