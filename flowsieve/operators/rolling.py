"""Trailing row-count window features over an explicit order key.

Frames are "this row and the k-1 rows before it" in ``order_col`` order
(optionally within ``partition_cols``), with at least one row required. The
statistics are those of ``operators.sliding``, all in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.columns import finite_or_null, float_columns, integral_columns
from flowsieve.operators.ordering import IDX, dense_index_with_total
from flowsieve.operators.sliding import sliding_statistics
from flowsieve.operators.stats import exact_medians


def integral_magnitudes(df: DataFrame, cols: list[str]) -> dict:
    """(min, max) per integral column (one aggregate row): the centre and
    width that decide whether exact power sums fit in 64 bits."""
    if not cols:
        return {}
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(F.col(f"`{c}`")).alias(f"lo{i}"), F.max(F.col(f"`{c}`")).alias(f"hi{i}")]
    row = df.agg(*aggs).collect()[0]
    return {c: (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def rolling_features(df: DataFrame, cols: list[str], order_col: str,
                     kinds=("var_std", "skew_kurt", "quantiles"),
                     partition_cols: list[str] | None = None,
                     bucket_rows: int | None = None) -> DataFrame:
    """Add the chosen trailing-window statistics for each column in ``cols``."""
    part = list(partition_cols or [])
    indexed, total = dense_index_with_total(df, part + [order_col])   # checkpointed once
    integral = [c for c in integral_columns(df) if c in cols]
    ranges = integral_magnitudes(indexed, integral)
    return sliding_statistics(indexed, [(k, c) for c in cols for k in kinds], part, ranges, bucket_rows, total).drop(IDX)


def extract_statistical_features(df: DataFrame, cols: list[str], order_col: str,
                                 partition_cols: list[str] | None = None,
                                 bucket_rows: int | None = None) -> DataFrame:
    """Per listed column: +-Inf to missing, exact median fill, then variance,
    std (5 rows), skewness, kurtosis, q25, q75, IQR (10 rows); missing -> 0.

    The input is indexed (and checkpointed) first, so the median and
    magnitude passes read the materialised copy instead of recomputing it.
    """
    floats = set(float_columns(df))
    cleaned = df.select(*[finite_or_null(F.col(f"`{c}`")).alias(c) if (c in cols and c in floats)
                          else F.col(f"`{c}`") for c in df.columns])
    part = list(partition_cols or [])
    indexed, total = dense_index_with_total(cleaned, part + [order_col])
    fit = exact_medians(indexed, cols, only_with_missing=True)
    fills = {c: m for c, m in fit.medians.items() if m is not None and fit.missing[c] > 0}
    if fills:
        indexed = indexed.fillna(fills)
    integral = [c for c in integral_columns(indexed) if c in cols]
    ranges = integral_magnitudes(indexed, integral)
    specs = [(k, c) for c in cols for k in ("var_std", "skew_kurt", "quantiles")]
    return sliding_statistics(indexed, specs, part, ranges, bucket_rows, total).drop(IDX).fillna(0)
