"""Record validation: required fields, typed casts with defaults, IP literals,
and fitting a feature vector to a model width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.schema import FLOW_FIELDS, REQUIRED_FIELDS

# Fixed patterns: dotted-quad IPv4 without leading zeros, and IPv6 text forms
# (full, compressed with '::'), no zone suffix.
IPV4_RE = (r"^(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
           r"(\.(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3}$")
H = "[0-9a-fA-F]{1,4}"
IPV6_RE = ("^(" + "|".join([
    f"({H}:){{7}}{H}",
    f"({H}:){{1,7}}:",
    f"({H}:){{1,6}}:{H}",
    f"({H}:){{1,5}}(:{H}){{1,2}}",
    f"({H}:){{1,4}}(:{H}){{1,3}}",
    f"({H}:){{1,3}}(:{H}){{1,4}}",
    f"({H}:){{1,2}}(:{H}){{1,5}}",
    f"{H}:(:{H}){{1,6}}",
    f":((:{H}){{1,7}}|:)",
]) + ")$")
INT_RE = r"^[+-]?[0-9]+$"
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def valid_ip(c: Column) -> Column:
    return F.coalesce(c.rlike(IPV4_RE) | c.rlike(IPV6_RE), F.lit(False))


def _typed(raw: Column, spark_type: str, text: bool = True) -> tuple[Column, Column]:
    """(value, ok) of a field: NULL stays NULL (default applied later); text
    must cast (integers must be written as integers), a number is cut to an
    integer and must fit."""
    txt = raw.cast("string")
    if not text and spark_type in ("int", "bigint"):
        val = raw.try_cast(spark_type)
        return val, raw.isNull() | val.isNotNull()
    if spark_type in ("int", "bigint"):
        ok = txt.isNull() | txt.rlike(INT_RE)
        return txt.try_cast(spark_type), ok
    if spark_type == "double":
        val = txt.try_cast("double")
        return val, txt.isNull() | val.isNotNull()
    return txt, F.lit(True)


def _fields(raw: DataFrame) -> list[tuple]:
    """(name, value with its default, [(reason, holds)]) of each canonical field."""
    types, out = dict(raw.dtypes), []
    for name, dtype, default in FLOW_FIELDS:
        tname = {"IntegerType()": "int", "LongType()": "bigint", "DoubleType()": "double"}.get(repr(dtype), None)
        raw_c = F.col(name) if name in types else F.lit(None)
        if name == "flow_ts":
            ts = raw_c.try_cast("timestamp_ntz")
            out.append((name, F.coalesce(ts, F.current_timestamp().cast("timestamp_ntz")),
                        [(f"bad {name}", raw_c.isNull() | ts.isNotNull())]))
            continue
        val, ok = _typed(raw_c, tname or "string", types.get(name) not in NUMBERS)
        rules = [(f"missing {name}", raw_c.isNotNull())] if name in REQUIRED_FIELDS else []
        rules.append((f"bad {name}", ok))
        if name in REQUIRED_FIELDS:
            rules.append((f"bad {name}", val.isNotNull()))
        if default is not None:
            val = F.coalesce(val, F.lit(default).cast(tname or "string"))
        out.append((name, val, rules))
    return out


def record_problem(raw: DataFrame) -> Column:
    """The first reason to reject a raw record, null for a good one: 'missing
    <field>' for a required field, 'bad <field>' for one that does not cast,
    then 'bad address src_ip' and 'bad address dst_ip'."""
    rules = [rule for _, _, found in _fields(raw) for rule in found]
    rules += [(f"bad address {c}", valid_ip(F.col(c)) if c in raw.columns else F.lit(False)) for c in ("src_ip", "dst_ip")]
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in rules])


def canonical_flows(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Canonical flow records from a frame of (mostly text) fields.

    Drops a record when a required field is missing, a present field does
    not cast, or either address is not an IPv4/IPv6 literal (``record_problem``
    says which); absent optional fields take their defaults, an absent flow time
    the time of ingest.
    """
    fields = _fields(raw)
    cond = None
    for _, _, rules in fields:
        for _, ok in rules:
            cond = ok if cond is None else cond & ok
    out = raw.select(*[F.col(k) for k in keep], *[val.alias(name) for name, val, _ in fields],
                     F.coalesce(cond, F.lit(False)).alias("_ok"))
    return out.where(F.col("_ok") & valid_ip(F.col("src_ip")) & valid_ip(F.col("dst_ip"))).drop("_ok")


def fit_width(arr: Column, n: int) -> Column:
    """Cut a numeric array to its first ``n`` values or pad it with zeros."""
    return F.slice(F.concat(arr.cast("array<double>"), F.array_repeat(F.lit(0.0), n)), 1, n)
