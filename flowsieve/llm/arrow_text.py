"""Words of Arrow text columns as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+``. The helpers work on the bytes of a string
column directly (offsets and data buffers), a bounded block of rows at a time,
so no Python object is made per word. Memory is proportional to the block, or
to one text where a single text is longer than a block. Null texts read as
empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BLOCK_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_PLAIN = np.arange(256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


# Spark's defaults send 10,000 texts or 64 MB to a Python worker at a time, and keep
# as much off the heap of each executor; a few MB are as fast.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
          "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts in small Arrow batches, unless its owner set
    their size."""
    for key, (default, smaller) in _BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, smaller)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data bytes, offsets of len + 1) of a string column; null is empty."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, dtype=np.int64)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str,
           max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about max_bytes of text: (rows, data, offsets)."""
    for batch in batches:
        data, offs = text_bytes(batch.column(column))
        a, n = 0, batch.num_rows
        while a < n:
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + max_bytes, side="right")) - 1)
            b = min(b, n)
            yield batch.slice(a, b - a), data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
            a = b


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word; no word spans two rows."""
    n = len(data)
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    if n > 1:
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cuts = offs[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        first[cuts] = solid[cuts]
        last[cuts - 1] = solid[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, side="right") - 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of each span's bytes; ``lower`` folds A-Z only."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    seg = np.concatenate(([0], np.cumsum(lens)[:-1]))
    inside = np.arange(int(lens.sum())) - np.repeat(seg, lens)
    power = np.full(int(lens.max()) + 1, _BASE, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    values = (_LOWER if lower else _PLAIN)[data[inside + np.repeat(starts, lens)]] + np.uint64(1)
    h = np.add.reduceat(values * power[inside], seg)
    return mix64(h + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def row_runs(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row value, first index) of each run in an ascending array."""
    if len(row) == 0:
        return row, np.zeros(0, dtype=np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1))
    return row[first], first
