"""Feature builders: dataset ratios, flow features, temporal features.

Each is one ``select`` over the input; a feature whose inputs are absent is
skipped on its own and reported in ``skipped`` of the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions import formulas as fx
from flowsieve.functions.columns import (finite_or_null, float_columns, integral_columns,
                                         numeric_columns)
from flowsieve.operators.ordering import IDX, dense_index_with_total
from flowsieve.operators.rolling import integral_magnitudes
from flowsieve.operators.sliding import sliding_statistics

@dataclass
class FeatureResult:
    frame: DataFrame
    feature_columns: list = field(default_factory=list)
    skipped: list = field(default_factory=list)


def _add(df: DataFrame, new: dict) -> DataFrame:
    keep = [F.col(f"`{c}`") for c in df.columns if c not in new]
    return df.select(*keep, *[v.alias(k) for k, v in new.items()])


def extract_features(df: DataFrame, targets=("label", "binary_label", "original_label"),
                     exclude=()) -> FeatureResult:
    """Packet totals, ratios, average size and per-microsecond rates.

    ``feature_columns`` lists all numeric non-target columns afterwards (the
    set later scaled and fed to models).
    """
    new = fx.basic_ratio_features(set(df.columns))
    wanted = ["total_packets", "fwd_bwd_packet_ratio", "total_bytes", "avg_packet_size",
              "flow_rate", "bytes_per_us"]
    out = _add(df, new)
    feats = numeric_columns(out, exclude=list(targets) + list(exclude))
    return FeatureResult(out, feats, [w for w in wanted if w not in new])


MOST_PROTOCOLS = 1000


def protocol_values(df: DataFrame, col: str = "protocol") -> list[str]:
    """Distinct protocol values, sorted: one row per output column. A column of
    more than ``MOST_PROTOCOLS`` values is no protocol and is refused."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(MOST_PROTOCOLS + 1).collect()
    if len(rows) > MOST_PROTOCOLS:
        raise ValueError(f"column {col!r} has more than {MOST_PROTOCOLS} values, too many for a column each")
    return sorted(r[0] for r in rows)


def flag_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df, exclude=[]) if "flag" in c.lower()]


def port_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df, exclude=[]) if "port" in c.lower()]


def extract_flow_features(df: DataFrame, protocols: list[str] | None = None,
                          flags: list[str] | None = None, ports: list[str] | None = None) -> FeatureResult:
    """Packet/byte/time/IAT features, flag totals, protocol one-hot, port classes.

    Flag and port columns are found by name unless given. Non-finite numbers
    become missing and every missing number becomes 0.
    """
    cols = set(df.columns)
    if protocols is None and "protocol" in cols:
        protocols = protocol_values(df)
    flags = flag_columns(df) if flags is None else flags
    ports = port_columns(df) if ports is None else ports
    new = fx.flow_features(cols, flags, ports, protocols)
    out = _add(df, new)
    floats = set(float_columns(out))
    out = out.select(*[finite_or_null(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`")
                       for c in out.columns])
    out = out.fillna(0, subset=numeric_columns(out, exclude=[]))
    return FeatureResult(out, list(new))


def extract_temporal_features(df: DataFrame, timestamp_col: str | None, order_col: str,
                              rolling_cols: list[str] | None = None,
                              partition_cols: list[str] | None = None,
                              bucket_rows: int | None = None) -> FeatureResult:
    """Calendar features of ``timestamp_col`` plus rolling mean/std (5, 10, 20
    rows) of the first five numeric columns, ordered by ``order_col``."""
    out = df
    new = []
    if timestamp_col and timestamp_col in df.columns:
        tf = fx.temporal_features(F.col(timestamp_col))
        out = _add(out, tf)
        new += list(tf)
    if rolling_cols is None:
        rolling_cols = numeric_columns(df, exclude=["label", "binary_label", "original_label",
                                                    order_col])[:5]
    if rolling_cols:
        part = list(partition_cols or [])
        indexed, total = dense_index_with_total(out, part + [order_col])
        ranges = integral_magnitudes(indexed, [c for c in integral_columns(out) if c in rolling_cols])
        out = sliding_statistics(indexed, [("mean_std", c) for c in rolling_cols], part, ranges, bucket_rows, total).drop(IDX)
        new += [f"{c}_rolling_{s}_{k}" for c in rolling_cols for k in (5, 10, 20) for s in ("mean", "std")]
    out = out.fillna(0, subset=numeric_columns(out, exclude=[]))
    return FeatureResult(out, new)
