"""Trailing-window statistics of ordered rows in one Arrow pass.

Spark deals the dense-indexed rows into buckets, each with the rows before it
(``ordering.halo_rows``), and sorts them; a task then walks its rows batch by
batch and computes all statistics of a batch with array operations, keeping
only the last ``MAX_HALO`` rows for the next one. A Spark window would
evaluate every aggregate anew over the rows of every frame.

Doubles are accumulated from the oldest row of a frame to the newest, with the
update rules of Spark's own moments. Integers give exact moments: in 64 bits
where the powers of their range fit, in Python integers beyond.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.functions.columns import integral_columns
from flowsieve.operators.ordering import IDX, MAX_BUCKET_ROWS, halo_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_HALO = 19                            # the widest frame is 20 rows
MAX_FRAME = MAX_HALO + 1
LONG_MAX = 9e18                          # below 2^63, margin for sums
DECIMAL_MAX = 9e37                       # beyond 38 digits integers are taken as doubles
EXACT_MOMENT_BOUND = 10_000_000          # the same for 4th powers: |x - centre|
VARIANCE_ROWS, SHAPE_ROWS, MEAN_ROWS = 5, 10, (5, 10, 20)

KINDS = {
    "var_std": ["variance", "std"],
    "skew_kurt": ["skewness", "kurtosis"],
    "quantiles": ["q25", "q75", "iqr"],
    "mean_std": [f"rolling_{s}_{k}" for k in MEAN_ROWS for s in ("mean", "std")],
}


def _back(a, j: int):
    """The values ``j`` rows earlier (the first value where there is none)."""
    if j == 0:
        return a
    out = np.empty_like(a)
    out[:j] = a[0]
    out[j:] = a[:-j]
    return out


class _Column:
    """One column of the rows at hand and its frames."""

    def __init__(self, array, reach, span):
        self.present = pc.is_valid(array).to_numpy(zero_copy_only=False)
        self.reach = reach               # rows before each row in its group
        integral = pa.types.is_integer(array.type)
        self.whole = pc.fill_null(array, 0).cast(pa.int64()).to_numpy() if integral else None
        self.x = (self.whole.astype(float) if integral
                  else pc.fill_null(array.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False))
        lo, hi = span if integral and span else (None, None)
        self.center = None if lo is None else (int(lo) + int(hi)) // 2
        self.dmax = None if lo is None else max(int(hi) - self.center, self.center - int(lo))

    def frame(self, values, rows):
        """(value, present) of each row of the frames, the oldest first."""
        for j in range(rows - 1, -1, -1):
            yield _back(values, j), _back(self.present, j) & (self.reach >= j)

    def count(self, rows):
        return sum(ok.astype(np.int64) for _, ok in self.frame(self.x, rows))

    def mean(self, rows):
        total = np.zeros(len(self.x))
        for x, ok in self.frame(self.x, rows):
            total = np.where(ok, total + x, total)
        n = self.count(rows)
        return np.where(n > 0, total / np.maximum(n, 1), 0.0)

    def centred(self, largest):
        """The distances from the centre of the column; Python integers where
        a result of ``largest`` does not fit in 64 bits."""
        d = np.where(self.present, self.whole, self.center) - self.center
        return d if largest < LONG_MAX else d.astype(object)

    def sum(self, values, rows, power=lambda v: v):
        return sum(np.where(ok, power(v), 0) for v, ok in self.frame(values, rows))

    def variance(self, rows):
        """Sample variance; 0 for less than two values."""
        n = self.count(rows)
        if self.dmax is not None and 2 * MAX_FRAME * MAX_BUCKET_ROWS * float(self.dmax) ** 2 < DECIMAL_MAX:
            d = self.centred(float(rows * self.dmax) ** 2)
            m2 = n * self.sum(d, rows, lambda v: v * v) - self.sum(d, rows) ** 2
            var = m2.astype(float) / np.maximum(n * (n - 1), 1)
        else:
            var = self.moments(rows, 2)[0] / np.maximum(n - 1, 1)
        return np.where(n > 1, var, 0.0)

    def moments(self, rows, order):
        """Central moment sums of doubles, as Spark updates them."""
        n, mean, m2, m3, m4 = (np.zeros(len(self.x)) for _ in range(5))
        for x, ok in self.frame(self.x, rows):
            delta = x - mean
            dn = delta / (n + 1.0)
            to2 = m2 + delta * (delta - dn)
            if order > 2:
                delta2, dn2 = delta * delta, dn * dn
                to3 = m3 - 3.0 * dn * to2 + delta * (delta2 - dn2)
                to4 = m4 - 4.0 * dn * to3 - 6.0 * dn2 * to2 + delta * (delta * delta2 - dn * dn2)
                m3, m4 = np.where(ok, to3, m3), np.where(ok, to4, m4)
            n, mean, m2 = np.where(ok, n + 1.0, n), np.where(ok, mean + dn, mean), np.where(ok, to2, m2)
        return m2, m3, m4

    def shape(self, rows):
        """Population skewness and excess kurtosis; 0 where the variance is."""
        n = self.count(rows)
        if self.dmax is not None and self.dmax <= EXACT_MOMENT_BOUND:
            # y = n * (x - mean) is whole, and so are the sums of its powers over n
            most = float(2 * rows * self.dmax)
            d = self.centred(rows * most ** 3)
            s1, some = self.sum(d, rows), np.maximum(n, 1)
            s2 = s3 = s4 = 0
            for v, ok in self.frame(d, rows):
                y = np.where(ok, n * v - s1, 0)
                y2 = y * y
                s2, s3 = s2 + y2, s3 + y2 * y
                s4 = s4 + (y2 * y2 if y.dtype == object or rows * most ** 4 < LONG_MAX else y2.astype(np.longdouble) ** 2)
            m2, m3 = (s2 // some).astype(float), (s3 // some).astype(float)
            m4 = (s4 / some if s4.dtype == np.longdouble else s4 // some).astype(float)
            g1, g2 = m3 / (m2 * np.sqrt(m2)), m4 / (m2 * m2) - 3.0
            return np.where(m2 == 0, 0.0, g1), np.where(m2 == 0, 0.0, g2), m2 == 0
        m2, m3, m4 = self.moments(rows, 4)
        return np.sqrt(n) * m3 / np.sqrt(m2 * m2 * m2), n * m4 / (m2 * m2) - 3.0, m2 == 0

    def sorted(self, rows):
        """The values of each frame in order, the missing ones last."""
        if getattr(self, "_sorted", None) is None:
            self._sorted = np.sort(np.stack([np.where(ok, x, np.nan) for x, ok in self.frame(self.x, rows)], axis=1), axis=1)
        return self._sorted

    def at(self, rows, place):
        return np.take_along_axis(self.sorted(rows), place.astype(np.int64)[:, None], axis=1)[:, 0]


def _var_std(c):
    v = c.variance(VARIANCE_ROWS)
    return [v, np.sqrt(v)]


def _skew_kurt(c):
    """Bias-corrected skewness (G1) and excess kurtosis (G2).

    Frames shorter than 3 (skewness) / 4 (kurtosis) values give 0; a constant
    frame gives 0 and -3.
    """
    n = c.count(SHAPE_ROWS).astype(float)
    g1, g2, flat = c.shape(SHAPE_ROWS)
    low, high = c.at(SHAPE_ROWS, np.zeros(len(n))), c.at(SHAPE_ROWS, np.maximum(n - 1, 0))
    const = (low == high) | (np.isnan(low) & np.isnan(high))
    skew = np.where(flat, 0.0, g1 * np.sqrt(n * (n - 1)) / (n - 2))
    kurt = np.where(flat, 0.0, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return [np.where((n < 3) | const, 0.0, skew), np.where(n < 4, 0.0, np.where(const, -3.0, kurt))]


def _quantiles(c):
    """Interpolated quartiles of the frame's values."""
    n = c.count(SHAPE_ROWS)

    def quantile(q):
        at = np.maximum(n - 1, 0) * q
        low, high = c.at(SHAPE_ROWS, np.floor(at)), c.at(SHAPE_ROWS, np.ceil(at))
        return np.where(n > 0, low + (high - low) * (at - np.floor(at)), 0.0)
    q25, q75 = quantile(0.25), quantile(0.75)
    return [q25, q75, q75 - q25]


def _mean_std(c):
    return [v for k in MEAN_ROWS for v in (c.mean(k), np.sqrt(c.variance(k)))]


COMPUTE = {"var_std": _var_std, "skew_kurt": _skew_kurt, "quantiles": _quantiles, "mean_std": _mean_std}


def _reach(batch, keys):
    """How many rows of its own group (equal ``keys``) stand before each row."""
    begins = np.ones(batch.num_rows, dtype=bool)
    begins[1:] = False
    for k in keys:
        now, before = batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)
        other = pc.coalesce(pc.not_equal(now, before), pc.xor(pc.is_null(now), pc.is_null(before)))
        begins[1:] |= other.to_numpy(zero_copy_only=False)
    row = np.arange(batch.num_rows)
    return row - np.maximum.accumulate(np.where(begins, row, 0))


def sliding_statistics(indexed: DataFrame, specs: list[tuple[str, str]], partition_cols: list[str], ranges: dict,
                       bucket_rows: int | None = None, total_rows: int | None = None) -> DataFrame:
    """Add the statistics ``specs`` = [(kind, column)] of the frames that end at each row.

    ``indexed`` carries the dense index of its rows by (``partition_cols``,
    order); frames stay inside a partition. ``ranges`` has (min, max) of the
    integer columns. A missing statistic is 0.
    """
    cols = list(dict.fromkeys(c for _, c in specs))
    whole = set(integral_columns(indexed))
    work = {c: f"_work{i}" for i, c in enumerate(cols)}
    keys = {c: f"_key{i}" for i, c in enumerate(partition_cols)}
    rows = halo_rows(indexed, MAX_HALO, bucket_rows, total_rows=total_rows)
    rows = rows.select("*", *[F.col(f"`{c}`").cast("long" if c in whole else "double").alias(n) for c, n in work.items()],
                       *[F.col(f"`{c}`").alias(n) for c, n in keys.items()]).sortWithinPartitions("_bucket", IDX)
    kept = indexed.columns
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in indexed.schema.fields],
                           *[T.StructField(f"{c}_{s}", T.DoubleType()) for k, c in specs for s in KINDS[k]]])
    groups, names = ["_bucket", *keys.values()], schema.names

    def run(batches):
        before = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            old = before.num_rows if before is not None else 0
            both = pa.concat_batches([before, batch]) if old else batch
            before = both.slice(max(0, both.num_rows - MAX_HALO))
            reach = _reach(both, groups)
            with np.errstate(all="ignore"):
                columns = {c: _Column(both.column(n), reach, ranges.get(c)) for c, n in work.items()}
                found = [v for kind, c in specs for v in COMPUTE[kind](columns[c])]
            mine = pc.equal(batch.column("_bucket"), batch.column("_own"))
            out = [batch.column(c) for c in kept] + [pa.array(v[old:]) for v in found]
            yield pa.RecordBatch.from_arrays(out, names=names).filter(mine)

    return rows.mapInArrow(run, schema)
