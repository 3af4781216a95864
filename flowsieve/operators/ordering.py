"""Distributed row order: dense row index and halo-bucketed windows.

A window with no ``partitionBy`` sends every row to one task. The helpers
here keep order-dependent work parallel at any size:

``dense_index``  range-partitions on the order key, numbers rows inside each
                 partition by their position (``monotonically_increasing_id``
                 after a per-partition sort) and adds the row count of all
                 earlier partitions. The only driver data is one count per
                 partition. Range bounds are sampled anew by every job, so the
                 tagged rows are written once (as Parquet, below the session's
                 shared checkpoint folder) and both the count and the numbering
                 read that copy; a lost executor re-reads it instead of
                 re-sampling, and later passes read the columns they need.
``halo_window``  cuts the indexed rows into buckets of ``bucket_rows`` and
                 copies the last ``halo`` rows of each bucket into the next,
                 so a trailing ROWS frame of up to ``halo + 1`` rows can be
                 evaluated per bucket; the copies are dropped afterwards.
                 A hot partition key is split over many buckets, because
                 buckets cut the global (key, order) sequence.
"""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.session import written

IDX = "_idx"
_LOCAL_BITS = 33


def _num_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return num_partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dense_index(df: DataFrame, order_cols: list, num_partitions: int | None = None,
                idx_col: str = IDX) -> DataFrame:
    """Add ``idx_col`` = 0-based position of each row in ``order_cols`` order.

    ``order_cols`` must define a total order (include a unique key).
    """
    return dense_index_with_total(df, order_cols, num_partitions, idx_col)[0]


def dense_index_with_total(df: DataFrame, order_cols: list, num_partitions: int | None = None,
                           idx_col: str = IDX) -> tuple[DataFrame, int]:
    """``dense_index`` plus the row count (known from the partition counts)."""
    n_parts = _num_partitions(df, num_partitions)
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    ranged = df.repartitionByRange(n_parts, *cols).sortWithinPartitions(*cols)
    mono = F.monotonically_increasing_id()
    tagged = written(ranged.withColumn("_mono", mono), "ordered")
    pid = F.shiftright(F.col("_mono"), _LOCAL_BITS)
    counts = (tagged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
              .collect())                     # one row per range partition
    offsets, running = [], 0
    for r in sorted(counts, key=lambda r: r["_pid"]):
        offsets.append((int(r["_pid"]), running))
        running += int(r["_n"])
    spark = df.sparkSession
    off = spark.createDataFrame(offsets or [(0, 0)], "_pid long, _off long")
    local = F.col("_mono").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    joined = tagged.join(F.broadcast(off), pid == F.col("_pid"))  # size = partition count
    return joined.select(*[F.col(f"`{c}`") for c in df.columns],
                         (F.col("_off") + local).alias(idx_col)), running


MAX_BUCKET_ROWS = 1_000_000


def bucket_size(spark, total_rows: int, halo: int, max_rows: int = MAX_BUCKET_ROWS) -> int:
    """Rows per halo bucket: about four buckets per core of the cluster,
    at most ``max_rows`` (bounded task memory), at least ``8 * (halo + 1)``
    (halo copies stay a small fraction)."""
    cores = max(1, spark.sparkContext.defaultParallelism)
    target = -(-max(total_rows, 1) // (4 * cores))
    return int(max(8 * (halo + 1), min(max_rows, target)))


def halo_rows(indexed: DataFrame, halo: int, bucket_rows: int | None = None, idx_col: str = IDX,
              total_rows: int | None = None) -> DataFrame:
    """The rows by ``_bucket`` of the dense index, each with copies of the
    ``halo`` rows before it, whose ``_own`` bucket is another."""
    if bucket_rows is None:
        bucket_rows = bucket_size(indexed.sparkSession, total_rows or MAX_BUCKET_ROWS, halo)
    if bucket_rows <= halo or bucket_rows > MAX_BUCKET_ROWS:
        raise ValueError("bucket_rows must exceed the halo size and stay within MAX_BUCKET_ROWS")
    idx = F.col(idx_col)
    own = F.floor(idx / bucket_rows).cast("long")
    is_tail = (idx % bucket_rows) >= (bucket_rows - halo)
    copies = F.when(is_tail, F.array(own, own + 1)).otherwise(F.array(own))
    # an explicit count: the rows are few bytes but many window columns, which
    # adaptive coalescing by size would put into one task
    return (indexed.select("*", own.alias("_own"), F.explode(copies).alias("_bucket"))
            .repartition(_num_partitions(indexed, None), "_bucket"))


def halo_window(indexed: DataFrame, partition_cols: list[str], halo: int,
                build, bucket_rows: int | None = None, idx_col: str = IDX,
                total_rows: int | None = None) -> DataFrame:
    """Evaluate trailing-frame window columns per bucket of the dense index.

    ``build(w)`` receives a ``Window`` spec (partitioned by bucket and
    ``partition_cols``, ordered by the index) and returns a list of named
    Columns, or ``(pre, cols)`` when ``cols`` read window columns computed
    first by ``pre`` (same spec: no extra shuffle or sort). Frames must not
    reach further back than ``halo`` rows; buckets hold at most
    ``MAX_BUCKET_ROWS`` rows.
    """
    if bucket_rows is None:
        bucket_rows = bucket_size(indexed.sparkSession, total_rows or MAX_BUCKET_ROWS, halo)
    spread = halo_rows(indexed, halo, bucket_rows, idx_col)
    w = Window.partitionBy("_bucket", *partition_cols).orderBy(idx_col)
    # builders that take a second argument learn the most rows a partition
    # holds (bucket plus halo), e.g. to size exact running sums
    takes_span = len(inspect.signature(build).parameters) > 1
    built = build(w, bucket_rows + halo) if takes_span else build(w)
    pre, cols = built if isinstance(built, tuple) else ([], built)
    staged = spread.select("*", *pre) if pre else spread
    keep = [F.col(f"`{c}`") for c in indexed.columns]
    # one projection: planning time grows with the number of window columns
    return (staged.select(*keep, *cols, (F.col("_bucket") == F.col("_own")).alias("_mine"))
            .where("_mine").drop("_mine"))


def trailing(w: Window, rows: int) -> Window:
    """Frame of the current row and the ``rows - 1`` rows before it."""
    return w.rowsBetween(-(rows - 1), 0)


def ordered_window(df: DataFrame, order_col: str, partition_cols: list[str] | None,
                   halo: int, build, bucket_rows: int | None = None,
                   num_partitions: int | None = None) -> DataFrame:
    """Dense-index ``df`` by ``(partition_cols, order_col)`` and apply ``build``."""
    part = list(partition_cols or [])
    indexed, total = dense_index_with_total(df, part + [order_col], num_partitions)
    out = halo_window(indexed, part, halo, build, bucket_rows, total_rows=total)
    return out.drop(IDX)



def running_totals(df: DataFrame, order_cols: list, sum_cols: dict, bucket_rows: int | None = None,
                   num_partitions: int | None = None) -> DataFrame:
    """Cumulative sums in ``order_cols`` order without a single-task window.

    ``sum_cols`` maps output name -> Column to accumulate. Rows are dense
    indexed, summed cumulatively inside buckets of ``bucket_rows``, and each
    bucket adds the total of all earlier buckets (a table of n / bucket_rows
    rows, broadcast back).
    """
    indexed, total = dense_index_with_total(df, order_cols, num_partitions)
    bucket_rows = bucket_rows or bucket_size(df.sparkSession, total, 0)
    spread = indexed.withColumn("_bucket", F.floor(F.col(IDX) / bucket_rows).cast("long"))
    spread = spread.select("*", *[c.alias(f"_v_{n}") for n, c in sum_cols.items()])
    w = (Window.partitionBy("_bucket").orderBy(IDX)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = spread.select("*", *[F.sum(f"_v_{n}").over(w).alias(f"_l_{n}") for n in sum_cols])
    totals = spread.groupBy("_bucket").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sum_cols])
    wb = (Window.orderBy("_bucket")
          .rowsBetween(Window.unboundedPreceding, -1))        # one row per bucket
    offsets = totals.select("_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(wb), F.lit(0)).alias(f"_o_{n}")
                                         for n in sum_cols])
    out = local.join(F.broadcast(offsets), "_bucket")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], F.col(IDX),
                      *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in sum_cols])
