"""Streaming sinks: append tables, per-batch metric snapshots, bounded drains,
and a per-batch callback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_table(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append a stream to a parquet table (exactly once via the checkpoint)."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    return w.trigger(**(trigger or {"availableNow": True})).start()


def write_batch(rows: DataFrame, path: str, batch_id: int, partition_cols: list[str] = ()) -> None:
    """Write a micro-batch's rows to its own ``batch_id=`` folder; a replayed
    batch replaces what it wrote before."""
    rows.write.mode("overwrite").partitionBy(*partition_cols).parquet(f"{path}/batch_id={batch_id}")


def write_by_day(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a micro-batch's rows by their ``_day``, and below a day by batch; a
    replayed batch replaces what it wrote before."""
    (rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("_day", "batch_id").parquet(path))


def day_rows(spark: SparkSession, path: str, days: list, batch_id: int) -> DataFrame | None:
    """What the batches up to ``batch_id`` wrote for some days (None: rows
    without a time); None if nothing. Folders of other days are not listed, so
    the cost of a micro-batch follows the days it touches, not the stream's age."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folders = []
    for day in days:
        folder = hadoop.Path(f"{path}/_day={'__HIVE_DEFAULT_PARTITION__' if day is None else day}")
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            folders.append(folder.toString())
    if not folders:
        return None
    return spark.read.option("basePath", path).parquet(*folders).where(F.col("batch_id") <= batch_id)


def append_new_rows(stream: DataFrame, path: str, checkpoint: str, key_cols: list[str], ts_col: str,
                    transform=None, trigger: dict | None = None):
    """Append the rows whose key no earlier row had, at any lateness.

    Rows are kept by day and a batch reads its own days only, to look for
    earlier keys (a repeated record has the same time). ``transform`` is applied to the
    new rows before they are written; it must keep ``key_cols`` and ``ts_col``.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(key_cols).withColumn("_day", F.to_date(ts_col))
        days = [r["_day"] for r in rows.select("_day").distinct().collect()]     # the days a batch touches
        old = day_rows(rows.sparkSession, path, days, batch_id - 1)
        if old is not None:
            old = old.select(*key_cols)
            rows = rows.join(old, [rows[c].eqNullSafe(old[c]) for c in key_cols], "left_anti")
        write_by_day(transform(rows) if transform else rows, path, batch_id)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def snapshot_per_batch(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Write each micro-batch's (updated) rows as one metrics snapshot with its
    time; readers take the latest per key."""
    def write(batch: DataFrame, batch_id: int):
        write_batch(batch.withColumn("snapshot_time", F.current_timestamp().cast("timestamp_ntz")), path, batch_id)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .outputMode("update").trigger(**(trigger or {"availableNow": True})).start())


def on_each_batch(stream: DataFrame, callback, checkpoint: str, trigger: dict | None = None):
    """Run ``callback(batch_df, batch_id)`` for every micro-batch."""
    return (stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def latest_snapshot(spark: SparkSession, path: str, key_cols: list[str] | None = None) -> DataFrame:
    """Rows of the newest batch per key (or the newest batch overall)."""
    df = spark.read.parquet(path)
    if not key_cols:
        last = df.agg(F.max("batch_id")).collect()[0][0]
        return df.where(F.col("batch_id") == last).drop("batch_id")
    newest = df.groupBy(*key_cols).agg(F.max("batch_id").alias("batch_id"))
    return df.join(newest, [*key_cols, "batch_id"]).drop("batch_id")


def drain(spark: SparkSession, path: str, after=None, max_rows: int = 100, ts_col: str = "timestamp",
          seq_col: str = "flow_seq") -> DataFrame:
    """Bounded, ordered read of a sink table after a high-water mark
    ``after = (ts, seq)``; the caller keeps the last row as the next mark."""
    df = spark.read.parquet(path)
    if after is not None:
        ts, seq = after
        df = df.where((F.col(ts_col) > F.lit(ts)) | ((F.col(ts_col) == F.lit(ts)) & (F.col(seq_col) > seq)))
    return df.orderBy(ts_col, seq_col).limit(max_rows)


def export_csv(df: DataFrame, path: str) -> None:
    """Batch export with a header row (alerts, history, processed tables);
    text is written as is (no whitespace trimming)."""
    (df.write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
