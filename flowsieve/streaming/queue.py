"""Queues between a stream and its consumers.

Rows are kept in the order of their arrival: by micro-batch, inside one by
event time and a unique key, so a replayed batch gives the same order. A
consumer's mark is the place of the last row it took. It says what has been
drained by arrival, so an alert that comes late, with a time long past, still
stands behind the mark and is drained, once. Marks are written beside the
queue; a consumer that restarts goes on from its last one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.operators.ordering import IDX, dense_index
from flowsieve.session import written
from flowsieve.streaming.sinks import write_batch


def enqueue(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append a stream's rows to the queue at ``path``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the finished ``name=<n>`` folders below the path, ascending."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*/_SUCCESS")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _place(ts_col: str, seq_col: str) -> Column:
    """Where a row stands in the queue; a null time comes first."""
    return F.struct(F.col("batch_id").cast("long").alias("batch_id"), F.col(ts_col).alias("ts"), F.col(seq_col).alias("seq"))


@dataclass
class Drained:
    """``rows``: what was taken, in order. ``commit`` moves the mark behind
    them; rows of an uncommitted drain are taken again by the next. With
    ``drain_col`` the rows are those of several drains, numbered in that column
    from ``number`` on, and ``commit`` marks each of them."""

    rows: DataFrame
    queue: "AlertQueue"
    number: int
    drain_col: str | None = None

    def commit(self) -> None:
        drain = (F.col(self.drain_col) if self.drain_col else F.lit(self.number)).cast("long")
        per = self.rows.groupBy(drain.alias("number")).agg(
            F.max(_place(self.queue.ts_col, self.queue.seq_col)).alias("place"), F.count(F.lit(1)).alias("n"))
        per = written(per, "queue-marks")                      # a row per drain
        last = per.agg(F.max("number")).first()[0]
        if last is not None:
            per.select("place", "n", "number").coalesce(1).write.mode("overwrite").parquet(f"{self.queue.marks}/mark={last}")


class AlertQueue:
    """A consumer's view of the queue at ``path``; ``consumer`` names its marks.
    ``ts_col`` may hold nulls, ``seq_col`` must be unique within a batch."""

    def __init__(self, spark: SparkSession, path: str, consumer: str = "default", ts_col: str = "timestamp",
                 seq_col: str = "flow_seq"):
        self.spark, self.path, self.ts_col, self.seq_col = spark, path, ts_col, seq_col
        self.marks = f"{path}_marks/{consumer}"

    def _mark(self):
        numbers = _folders(self.spark, self.marks, "mark")
        if not numbers:
            return 0, None
        last = self.spark.read.parquet(f"{self.marks}/mark={numbers[-1]}").agg(F.max("place").alias("place")).first()
        return numbers[-1], last.place

    def take(self, max_rows: int = 100) -> Drained:
        """The next rows behind the mark, in order of arrival, ``max_rows`` at
        most (the bound of a drain). Only batches from the mark on are read."""
        number, rows = self._behind()
        return Drained(rows.orderBy("batch_id", self.ts_col, self.seq_col).limit(max_rows), self, number + 1)

    def take_all(self, max_rows: int = 100, drain_col: str = "drain") -> Drained:
        """All rows behind the mark as the drains that one ``take`` after the
        other would give, each ``max_rows`` at most, numbered in ``drain_col``.
        The queue is read once, whatever the number of drains."""
        number, rows = self._behind()
        placed = dense_index(rows, ["batch_id", self.ts_col, self.seq_col])
        numbered = placed.withColumn(drain_col, F.floor(F.col(IDX) / max_rows).cast("long") + F.lit(number + 1)).drop(IDX)
        return Drained(numbered, self, number + 1, drain_col)

    def _behind(self) -> tuple[int, DataFrame]:
        """(number of the last drain, rows behind its mark)."""
        number, place = self._mark()
        batches = [b for b in _folders(self.spark, self.path, "batch_id") if place is None or b >= place.batch_id]
        if not batches:
            schema = T.StructType([T.StructField(self.ts_col, T.TimestampNTZType()), T.StructField(self.seq_col, T.LongType()),
                                   T.StructField("batch_id", T.LongType())])
            return number, self.spark.createDataFrame([], schema)
        rows = self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/batch_id={b}" for b in batches])
        if place is not None:
            kinds = {f: rows.schema[c].dataType for f, c in (("ts", self.ts_col), ("seq", self.seq_col))}
            mark = F.struct(F.lit(place.batch_id).cast("long").alias("batch_id"),
                            *[F.lit(place[f]).cast(kinds[f]).alias(f) for f in ("ts", "seq")])
            rows = rows.where(_place(self.ts_col, self.seq_col) > mark)
        return number, rows

    def release(self) -> int:
        """Delete the batches that lie wholly before this consumer's mark, and
        all but its newest mark; returns how many batches. For the queue's last
        consumer."""
        number, place = self._mark()
        done = [b for b in _folders(self.spark, self.path, "batch_id") if place is not None and b < place.batch_id]
        for b in done:
            _delete(self.spark, f"{self.path}/batch_id={b}")
        for m in _folders(self.spark, self.marks, "mark"):
            if m < number:
                _delete(self.spark, f"{self.marks}/mark={m}")
        return len(done)
