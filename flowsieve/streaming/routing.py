"""Records to two sinks, and counters taken while they are written.

``route_records`` classifies each record once: the first rule it breaks is its
reason, and good and rejected records are written in the same pass, below
``accepted=true`` and ``accepted=false`` of the micro-batch's folder. Rejected
records keep all their fields as they came. Metrics observed in that pass must
add up: good and rejected records together are all that were read.

``counted_alerts`` scores the same way: totals are observed while the scored
flows are written, added to those of the batch before, and kept as a snapshot a
batch, so a replayed batch replaces its own and a restart goes on from the last.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.validate import canonical_flows, record_problem
from flowsieve.streaming.queue import _folders
from flowsieve.streaming.sinks import write_batch


def classified(raw: DataFrame) -> DataFrame:
    """The raw records with ``reject_reason`` (null for good ones)."""
    return raw.withColumn("reject_reason", record_problem(raw))


def route_records(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Write a stream of raw records to ``path``, good and rejected ones apart,
    with the counts of each micro-batch below ``<path>_counts``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        seen, kept = Observation(), Observation()
        rows = batch.observe(seen, F.count(F.lit(1)).alias("read"))
        marked = classified(rows).withColumn("accepted", F.col("reject_reason").isNull())
        marked = marked.observe(kept, F.coalesce(F.sum(F.col("accepted").cast("long")), F.lit(0)).alias("good"),
                                F.coalesce(F.sum((~F.col("accepted")).cast("long")), F.lit(0)).alias("rejected"))
        write_batch(marked, path, batch_id, ["accepted"])
        read, good, rejected = seen.get["read"], kept.get["good"], kept.get["rejected"]
        if good + rejected != read:
            raise RuntimeError(f"batch {batch_id}: {read} records read, {good} good and {rejected} rejected")
        counts = batch.sparkSession.createDataFrame([(read, good, rejected)], "records long, good long, rejected long")
        write_batch(counts.coalesce(1), f"{path}_counts", batch_id)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def accepted_flows(spark: SparkSession, path: str, keep: list[str] = ()) -> DataFrame:
    """Canonical flows of the good records."""
    good = spark.read.parquet(path).where("accepted = 'true'").drop("accepted", "batch_id", "reject_reason")
    return canonical_flows(good, keep)


def rejected_records(spark: SparkSession, path: str) -> DataFrame:
    """The rejected records as they came, with their reason."""
    return spark.read.parquet(path).where("accepted = 'false'").drop("accepted", "batch_id")


TOTALS = {"total_flows_processed": "count(1)", "malicious_flows": "count_if(prediction = 'MALICIOUS')",
          "alerts_generated": "count_if(alert)"}


def counted_alerts(scored: DataFrame, path: str, checkpoint: str, data_source: str, trigger: dict | None = None,
                   clock=time.time):
    """Write scored flows to ``path`` and a counter snapshot a micro-batch to
    ``<path>_counters``: totals since the first batch, when that began, the name
    of the source."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, counters = batch.sparkSession, f"{path}_counters"
        before = [b for b in _folders(spark, counters, "batch_id") if b < batch_id]
        last = spark.read.parquet(f"{counters}/batch_id={before[-1]}").first() if before else None
        now = clock()
        seen = Observation()
        write_batch(batch.observe(seen, *[F.expr(v).alias(k) for k, v in TOTALS.items()]), path, batch_id)
        total = [seen.get[k] + (last[k] if last else 0) for k in TOTALS]
        row = (*total, data_source, float(last.started if last else now), float(now))
        snapshot = spark.createDataFrame([row], ", ".join(f"{k} long" for k in TOTALS) + ", data_source string, started double, at double")
        write_batch(snapshot.coalesce(1), counters, batch_id)

    return (scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def counter_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot, one row: totals, benign flows, rates in percent,
    uptime_seconds, flows_per_second, data_source; all 0 before the first batch."""
    batches = _folders(spark, f"{path}_counters", "batch_id")
    if not batches:
        return spark.createDataFrame([(0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, None)], "total_flows_processed long, malicious_flows long, "
                                     "alerts_generated long, benign_flows long, detection_rate double, alert_rate double, "
                                     "uptime_seconds double, flows_per_second double, data_source string")
    row = spark.read.parquet(f"{path}_counters/batch_id={batches[-1]}")
    total = F.greatest(F.col("total_flows_processed"), F.lit(1))
    uptime = F.col("at") - F.col("started")
    return row.select(*TOTALS, (F.col("total_flows_processed") - F.col("malicious_flows")).alias("benign_flows"),
                      (F.lit(100.0) * F.col("malicious_flows") / total).alias("detection_rate"),
                      (F.lit(100.0) * F.col("alerts_generated") / total).alias("alert_rate"),
                      uptime.alias("uptime_seconds"),
                      F.coalesce(F.try_divide(F.col("total_flows_processed"), uptime), F.lit(0.0)).alias("flows_per_second"),
                      "data_source")
