"""Streaming alert operators: rate limiter, running counters, per-minute
counts, stream cleaning.

Nothing that arrives late is lost. The limiter keeps its attempts in a table
and, for each micro-batch, decides again every attempt that the new ones can
touch, with the batch limiter; readers take the newest decision of an attempt
(``sinks.latest_snapshot``). So the result equals the batch form for any number
of rows per key, any order inside a trigger and any lateness. Every batch
writes its own ``batch_id=`` folder, so a replayed batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.alerts import rate_limit
from flowsieve.streaming.sinks import day_rows, write_batch, write_by_day

MICROS = 1_000_000


def rate_limit_query(alerts: DataFrame, attempts: str, out: str, checkpoint: str, ts_col: str = "timestamp",
                     seq_col: str = "flow_seq", cap: int = 100, window_seconds: int = 60,
                     key_cols: list[str] | None = None, trigger: dict | None = None):
    """Streaming twin of ``operators.alerts.rate_limit``: writes alerts with
    ``window_count`` and ``passed`` to ``out``, a snapshot per micro-batch.

    ``attempts`` holds all attempts by day. A new attempt in the time slice s
    (one window long) can change attempts of its key in s and s + 1, and those
    count attempts back to s - 1: only these slices are read, from their days.
    """
    keys = list(key_cols or [])
    slice_of = F.floor(F.unix_micros(F.col(ts_col).cast("timestamp")) / (window_seconds * MICROS)).cast("long")

    def same(left: DataFrame, right: DataFrame):
        return [left[c].eqNullSafe(right[c]) for c in [*keys, "_slice"]]

    def decide(batch: DataFrame, batch_id: int) -> None:
        columns = batch.columns
        staged = batch.withColumn("_slice", slice_of).withColumn("_day", F.to_date(ts_col))
        write_by_day(staged, attempts, batch_id)
        new = staged.select(*keys, "_slice").distinct()
        touched = new.withColumn("_slice", F.explode(F.array("_slice", F.col("_slice") + 1))).distinct()
        needed = touched.withColumn("_slice", F.explode(F.array(F.col("_slice") - 1, "_slice"))).distinct()
        start, end = (F.to_date(F.timestamp_micros((F.col("_slice") + i) * window_seconds * MICROS)) for i in (0, 1))
        days = needed.select("_slice").distinct().select(F.explode(F.sequence(start, end)).alias("d")).distinct()
        days = [r["d"] for r in days.collect()]                   # the days a batch touches
        context = day_rows(batch.sparkSession, attempts, [*days, None], batch_id)
        if context is None:
            return
        context = context.join(needed, same(context, needed), "left_semi")
        decided = rate_limit(context, ts_col, cap, window_seconds, keys or None, seq_col=seq_col)
        decided = decided.join(touched, same(decided, touched), "left_semi")
        write_batch(decided.select(*columns, "window_count", "passed"), out, batch_id)

    return (alerts.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def counters_stream(scored: DataFrame) -> DataFrame:
    """Running totals over everything seen (update/complete output mode)."""
    return scored.agg(F.count(F.lit(1)).alias("total_flows_processed"),
                      F.count_if(F.col("prediction") == "MALICIOUS").alias("malicious_flows"),
                      F.count_if(F.col("alert")).alias("alerts_generated"))


def minute_counts_query(alerts: DataFrame, out: str, checkpoint: str, ts_col: str = "timestamp",
                        trigger: dict | None = None):
    """Alerts per minute without state: each micro-batch writes its own counts
    and ``minute_counts`` adds them, so late alerts still count."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.groupBy(F.date_trunc("minute", ts_col).cast("timestamp_ntz").alias("minute"))
                    .agg(F.count(F.lit(1)).alias("n_alerts")), out, batch_id)

    return (alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def minute_counts(spark, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("minute").agg(F.sum("n_alerts").alias("n_alerts"))


def minute_windows_stream(alerts: DataFrame, ts_col: str = "timestamp", watermark: str | None = None) -> DataFrame:
    """Tumbling one-minute alert counts as a stateful aggregate. A watermark
    bounds the state and gives up later alerts; without one nothing is lost."""
    ts = F.col(ts_col).cast("timestamp")
    timed = alerts.withColumn("_event_time", ts)
    if watermark:
        timed = timed.withWatermark("_event_time", watermark)
    return (timed.groupBy(F.window("_event_time", "1 minute").alias("w"))
            .agg(F.count(F.lit(1)).alias("n_alerts"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("minute"), "n_alerts"))


def clean_stream(flows: DataFrame, medians: dict) -> DataFrame:
    """Stream cleaning with medians frozen at training time; repeated records
    are left out where the rows are written (``sinks.append_new_rows``)."""
    out = flows
    for c, m in medians.items():
        x = F.col(c)
        out = out.withColumn(c, F.when(x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")),
                                       F.lit(m)).otherwise(x))
    return out
