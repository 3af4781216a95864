"""Registered queries: alerts, rate limit, counters and history analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.columns import r6
from flowsieve.operators import alerts as al
from flowsieve.sources.tables import scored_flows

HISTORY_RANGE = ("2024-01-05", "2024-01-20")


def _scored(spark, sf_dir):
    return al.score_flows(scored_flows(spark, sf_dir), "score", 0.7)


def _alerts(spark, sf_dir):
    return al.make_alerts(_scored(spark, sf_dir))


def q_score_to_alerts(spark, sf_dir):
    return _alerts(spark, sf_dir)


def q_alert_rate_limited(spark, sf_dir):
    limited = al.rate_limit(_alerts(spark, sf_dir), "timestamp", cap=20, window_seconds=6 * 3600)
    return limited.select("flow_seq", "timestamp", "window_count", "passed")


def q_severity_counts(spark, sf_dir):
    return al.severity_counts(_alerts(spark, sf_dir))


def q_alerts_per_minute(spark, sf_dir):
    out = al.alerts_per_minute(_alerts(spark, sf_dir))
    return out.select(F.col("minute").cast("timestamp_ntz").alias("minute"), "n_alerts")


def q_alert_summary(spark, sf_dir):
    out = al.alert_summary(_alerts(spark, sf_dir))
    return out.select("total_alerts", "critical_alerts", "high_alerts",
                      r6(F.col("avg_confidence")).alias("avg_confidence"))


def q_alert_filter_top(spark, sf_dir):
    out = al.filter_alerts(_alerts(spark, sf_dir), "HIGH", 0.85, 50)
    return out.select("flow_seq", "timestamp", "severity", "flow_id", "confidence",
                      "description", "recommended_action")


def q_recent_alerts(spark, sf_dir):
    out = al.recent_alerts(_alerts(spark, sf_dir), 10)
    return out.select("flow_seq", "timestamp", "severity", "flow_id", "confidence")


def q_running_counters(spark, sf_dir):
    out = al.running_counters(_scored(spark, sf_dir))
    return out.select("flow_seq", "total_flows_processed", "malicious_flows", "benign_flows",
                      "alerts_generated", r6(F.col("detection_rate")).alias("detection_rate"),
                      r6(F.col("alert_rate")).alias("alert_rate"))


def q_pipeline_stats(spark, sf_dir):
    out = al.pipeline_statistics(_scored(spark, sf_dir))
    return out.select("total_flows_processed", "benign_flows", "malicious_flows", "alerts_generated",
                      *[r6(F.col(c)).alias(c) for c in ("uptime_seconds", "flows_per_second",
                                                        "detection_rate", "alert_rate")])


def q_history_range_summary(spark, sf_dir):
    hist = al.hourly_history(_scored(spark, sf_dir))
    out = al.history_summary(hist, *HISTORY_RANGE)
    return out.select("total_flows", "malicious_flows",
                      r6(F.col("avg_detection_rate")).alias("avg_detection_rate"),
                      "total_alerts", "n_snapshots")


def q_detection_rate_histogram(spark, sf_dir):
    hist = al.hourly_history(_scored(spark, sf_dir))
    out = al.value_histogram(hist, "detection_rate", 10)
    return out.select("bin", r6(F.col("bin_start")).alias("bin_start"),
                      r6(F.col("bin_end")).alias("bin_end"), "n")


def q_alert_rate_limited_by_source(spark, sf_dir):
    """One limiter per source address: cap 2 attempts per trailing 7 days."""
    limited = al.rate_limit(_alerts(spark, sf_dir), "timestamp", cap=2, window_seconds=7 * 86400,
                            key_cols=["src_ip"])
    return limited.select("flow_seq", "src_ip", "timestamp", "window_count", "passed")
