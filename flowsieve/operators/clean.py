"""Cleaning operators: header standardisation, missing values, de-duplication.

``clean_dataset`` = standardise names -> drop all-missing rows -> +-Inf to
missing -> exact median imputation -> full-row de-duplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.columns import finite_or_null, float_columns, missing, numeric_columns
from flowsieve.operators.stats import exact_medians
from flowsieve.schema import COLUMN_ALIASES, TARGET_COLUMNS


def standardize_columns(df: DataFrame, aliases: dict = COLUMN_ALIASES) -> DataFrame:
    """Rename the first present alias of each standard column (plan time).

    Raises when a rename would produce a duplicate column name.
    """
    renames = {}
    for standard, variants in aliases.items():
        for v in variants:
            if v in df.columns:
                if v != standard:
                    renames[v] = standard
                break
    names = [renames.get(c, c) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"renaming {renames} would duplicate a column in {df.columns}")
    if not renames:
        return df
    return df.select(*[F.col(f"`{c}`").alias(renames.get(c, c)) for c in df.columns])


def drop_all_missing_rows(df: DataFrame) -> DataFrame:
    """Drop rows where every cell is NULL (or NaN)."""
    return df.dropna(how="all")


def infinity_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """+-Inf (and NaN) in floating columns become NULL."""
    targets = set(cols if cols is not None else float_columns(df))
    return df.select(*[finite_or_null(F.col(f"`{c}`")).alias(c) if c in targets else F.col(f"`{c}`")
                       for c in df.columns])


def impute_median(df: DataFrame, cols: list[str] | None = None,
                  target: str = "label") -> tuple[DataFrame, dict]:
    """Fill missing numeric cells with the column's exact median.

    Returns the filled frame and the medians used (a column whose values
    are all missing stays missing).
    """
    cols = cols if cols is not None else numeric_columns(df, exclude=[target] + TARGET_COLUMNS)
    fit = exact_medians(df, cols, only_with_missing=True)
    fills = {c: m for c, m in fit.medians.items() if m is not None and fit.missing[c] > 0}
    if not fills:
        return df, fills
    out = []
    for c in df.columns:
        if c in fills:
            x = F.col(f"`{c}`")
            floating = c in float_columns(df)
            miss = missing(x, floating)
            # An integral column filled with a fractional median becomes double.
            dtype = "double" if (not floating and fills[c] != int(fills[c])) else df.schema[c].dataType
            out.append(F.when(miss, F.lit(fills[c]).cast(dtype)).otherwise(x.cast(dtype)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out), fills


def zero_fill(df: DataFrame) -> DataFrame:
    """Missing numeric cells -> 0 (text columns untouched)."""
    return df.fillna(0, subset=numeric_columns(df, exclude=[]))


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Full-row de-duplication; partial aggregation collapses copies map-side."""
    return df.dropDuplicates()


def clean_dataset(df: DataFrame, target: str = "label") -> DataFrame:
    """Standardise -> drop all-missing rows -> Inf to missing -> median fill -> de-dup."""
    out = standardize_columns(df)
    out = drop_all_missing_rows(out)
    out = infinity_to_null(out)
    out, _ = impute_median(out, target=target)
    return drop_duplicate_rows(out)
