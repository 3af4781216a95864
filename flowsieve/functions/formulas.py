"""Per-row feature formulas as Spark Column expressions.

Each builder returns ``{name: Column}`` for the features whose inputs are
present in ``cols`` (a set of column names); a feature whose input is missing
is skipped on its own, never together with the features after it. The
``+1`` in denominators is the divide guard of the formulas being matched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FWD, BWD = "total_fwd_packets", "total_backward_packets"
FWD_LEN, BWD_LEN = "total_length_fwd_packets", "total_length_bwd_packets"
DUR = "flow_duration"
IAT_MEAN, IAT_STD = "flow_iat_mean", "flow_iat_std"


def c(name: str) -> Column:
    return F.col(f"`{name}`")


def _d(x: Column) -> Column:
    return x.cast("double")


def _div(num: Column, den) -> Column:
    """Double division; NULL instead of an error when the divisor is 0."""
    den = den if isinstance(den, Column) else F.lit(den)
    return F.try_divide(_d(num), _d(den))


def basic_ratio_features(cols: set) -> dict:
    """Dataset-level ratios: packets, bytes, packet size, rates per microsecond."""
    out = {}
    if FWD in cols and BWD in cols:
        out["total_packets"] = c(FWD) + c(BWD)
        out["fwd_bwd_packet_ratio"] = _div(c(FWD), c(BWD) + 1)
    if FWD_LEN in cols and BWD_LEN in cols:
        out["total_bytes"] = c(FWD_LEN) + c(BWD_LEN)
        if "total_packets" in out:
            out["avg_packet_size"] = _div(out["total_bytes"], out["total_packets"] + 1)
    if DUR in cols:
        if "total_packets" in out:
            out["flow_rate"] = _div(out["total_packets"], c(DUR) + 1)
        if "total_bytes" in out:
            out["bytes_per_us"] = _div(out["total_bytes"], c(DUR) + 1)
    return out


def flow_features(cols: set, flag_cols: list[str], port_cols: list[str],
                  protocol_values: list[str] | None) -> dict:
    """Packet, byte, time, inter-arrival, flag, protocol and port features."""
    out = {}
    if FWD in cols and BWD in cols:
        out["total_packets"] = c(FWD) + c(BWD)
        out["fwd_bwd_packet_ratio"] = _div(c(FWD), c(BWD) + 1)
        out["packet_asymmetry"] = F.abs(c(FWD) - c(BWD))
    if FWD_LEN in cols and BWD_LEN in cols:
        out["total_bytes"] = c(FWD_LEN) + c(BWD_LEN)
        out["fwd_bwd_bytes_ratio"] = _div(c(FWD_LEN), c(BWD_LEN) + 1)
        out["bytes_asymmetry"] = F.abs(c(FWD_LEN) - c(BWD_LEN))
        if FWD in cols:
            out["avg_fwd_packet_size"] = _div(c(FWD_LEN), c(FWD) + 1)
        if BWD in cols:
            out["avg_bwd_packet_size"] = _div(c(BWD_LEN), c(BWD) + 1)
        if "total_packets" in out:
            out["avg_packet_size"] = _div(out["total_bytes"], out["total_packets"] + 1)
    if DUR in cols:
        out["flow_duration_log"] = F.log1p(c(DUR))
        secs = c(DUR) / 1000000.0 + 1
        if "total_packets" in out:
            out["packets_per_second"] = _div(out["total_packets"], secs)
        if "total_bytes" in out:
            out["bytes_per_second"] = _div(out["total_bytes"], secs)
    if IAT_MEAN in cols:
        out["flow_iat_log"] = F.log1p(c(IAT_MEAN))
        if IAT_STD in cols:
            out["flow_iat_cv"] = _div(c(IAT_STD), c(IAT_MEAN) + 1)
    if flag_cols:
        vals = [F.coalesce(_d(c(f)), F.lit(0.0)) for f in flag_cols]
        total = vals[0]
        for v in vals[1:]:
            total = total + v
        out["total_flags"] = total
        pos = [F.when(c(f) > 0, 1).otherwise(0) for f in flag_cols]
        div = pos[0]
        for p in pos[1:]:
            div = div + p
        out["flag_diversity"] = div
    if protocol_values is not None and "protocol" in cols:
        for v in protocol_values:
            out[f"protocol_{v}"] = F.when(c("protocol") == F.lit(v), 1).otherwise(0)
    for p in port_cols:
        out[f"{p}_is_wellknown"] = F.when(c(p) <= 1023, 1).otherwise(0)
        out[f"{p}_is_registered"] = F.when((c(p) > 1023) & (c(p) <= 49151), 1).otherwise(0)
        out[f"{p}_is_dynamic"] = F.when(c(p) > 49151, 1).otherwise(0)
    return out


def temporal_features(ts: Column) -> dict:
    """Calendar fields and cyclic encodings of a timestamp (Monday = 0)."""
    hour = F.hour(ts)
    dow = F.weekday(ts)
    two_pi = 2 * math.pi
    return {
        "hour": hour,
        "day_of_week": dow,
        "month": F.month(ts),
        "is_weekend": F.when(dow >= 5, 1).otherwise(0),
        "is_business_hours": F.when((hour >= 9) & (hour <= 17), 1).otherwise(0),
        "is_night": F.when((hour >= 22) | (hour <= 6), 1).otherwise(0),
        "hour_sin": F.sin(two_pi * hour / 24),
        "hour_cos": F.cos(two_pi * hour / 24),
        "day_sin": F.sin(two_pi * dow / 7),
        "day_cos": F.cos(two_pi * dow / 7),
    }


def interaction_terms(a: str, b: str) -> dict:
    """Product, guarded ratio and difference of two columns."""
    return {
        f"{a}_x_{b}": _d(c(a)) * c(b),
        f"{a}_div_{b}": _div(c(a), c(b) + 1e-8),
        f"{a}_diff_{b}": _d(c(a)) - c(b),
    }
