"""Plan-time column helpers: type inspection and null/non-finite tests.

None of these run a job; they read ``df.schema`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.schema import TARGET_COLUMNS

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def numeric_columns(df: DataFrame, exclude=TARGET_COLUMNS) -> list[str]:
    """Numeric columns in schema order, minus targets."""
    skip = set(exclude or [])
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in skip]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, FLOAT_TYPES)]


def integral_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))]


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, FLOAT_TYPES)


def finite_or_null(c: Column) -> Column:
    """NaN, +Inf and -Inf become NULL (other values unchanged)."""
    return F.when(F.isnan(c) | c.isin(float("inf"), float("-inf")), F.lit(None)).otherwise(c)


def missing(c: Column, floating: bool) -> Column:
    """True when the value is NULL (or NaN for floating columns)."""
    return (c.isNull() | F.isnan(c)) if floating else c.isNull()


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields NULL (not an error) on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def r6(c: Column) -> Column:
    """Result presentation of a double: round half up to 6 decimal places.

    Written as floor(x * 1e6 + 0.5) / 1e6 so every step is one IEEE
    operation and any engine gives the same bits; |x| >= 1e9 (where the
    scaled value would pass 2^53) and NaN are returned unchanged; -0.0 -> 0.0.
    """
    x = c.cast("double")
    scaled = F.floor(x * F.lit(1000000.0) + F.lit(0.5)).cast("double") / F.lit(1000000.0)
    return F.when(F.isnan(x) | (F.abs(x) >= F.lit(1e9)), x + F.lit(0.0)).otherwise(scaled + F.lit(0.0))
