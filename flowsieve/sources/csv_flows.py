"""Flow CSV sources: dataset files with separator/encoding sniffing, and
flow-exporter CSVs mapped to the canonical record.

Values are read as text and cast per column, so ``inf``, ``-Infinity``, ``nan`` and ``1e3`` parse
as numbers (a typed CSV schema would turn ``inf`` into NULL).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.operators.clean import standardize_columns
from flowsieve.schema import CIC_HEADER_MAP, DATASET_HEADER_MAP

SEPARATORS = [",", ";", "\t"]
ENCODINGS = ["utf-8", "iso-8859-1"]   # latin-1 is iso-8859-1
CIC_NUMERIC = ["flow_duration", "total_fwd_packets", "total_backward_packets",
               "total_length_fwd_packets", "total_length_bwd_packets", "fwd_packet_length_max",
               "fwd_packet_length_min", "fwd_packet_length_mean", "flow_bytes_s", "flow_packets_s",
               "flow_iat_mean", "flow_iat_std"]


def snake(name: str) -> str:
    return re.sub(r"[^0-9a-zA-Z]+", "_", name.strip()).strip("_").lower()


def sniff_files(spark: SparkSession, path: str) -> dict[tuple[str, str], list[str]]:
    """Files of a path by (separator, encoding).

    Each file is read whole: one line that is not valid UTF-8 makes the file
    latin-1. The separator is the first that splits the file's first line into
    more than one field. The driver gets one row per file.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n")).alias("at"))
    files = lines.groupBy("file").agg(F.min_by("value", "at").alias("head"),
                                      F.bool_and(F.is_valid_utf8("value")).alias("utf8")).collect()
    out: dict[tuple[str, str], list[str]] = {}
    for r in sorted(files, key=lambda r: r["file"]):
        sep = next((s for s in SEPARATORS if s in r["head"]), SEPARATORS[-1])
        out.setdefault((sep, ENCODINGS[0] if r["utf8"] else ENCODINGS[1]), []).append(r["file"])
    return out


def sniff_csv(spark: SparkSession, path: str) -> tuple[str, str]:
    """(separator, encoding) of a file, or of the first file of a folder."""
    return next(iter(sniff_files(spark, path)), (",", ENCODINGS[0]))


def numeric_text_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """Text columns whose every non-empty value casts to a number (one scan)."""
    cols = cols if cols is not None else df.columns
    if not cols:
        return []
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & (F.trim(F.col(f"`{c}`")) != "")
                              & F.col(f"`{c}`").try_cast("double").isNull()).alias(f"b{i}")
                   for i, c in enumerate(cols)]
                 + [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)]).collect()[0]
    return [c for i, c in enumerate(cols) if row[f"b{i}"] == 0 and row[f"n{i}"] > 0]


def load_flow_csv(spark: SparkSession, path: str, numeric: list[str] | None = None,
                  trim_headers: bool = True) -> DataFrame:
    """Dataset CSV: sniffed separator and encoding, header names trimmed and
    mapped to snake_case, numeric columns cast to double, standard names
    (label, flow_duration, packet counts) applied."""
    raw = None
    for (sep, enc), files in sniff_files(spark, path).items():
        part = spark.read.option("header", True).option("sep", sep).option("encoding", enc).csv(files)
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    if raw is None:
        raw = spark.read.option("header", True).csv(path)
    names = {}
    for c in raw.columns:
        h = c.strip() if trim_headers else c
        names[c] = DATASET_HEADER_MAP.get(h, h)
    df = raw.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    df = standardize_columns(df)
    df = df.select(*[F.col(f"`{c}`").alias(snake(c)) for c in df.columns])
    nums = numeric if numeric is not None else numeric_text_columns(df, [c for c in df.columns if c != "label"])
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in nums else F.col(c) for c in df.columns])


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded table: header row, types inferred by Spark."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def measure(text: Column) -> Column:
    """A measure's number; missing, not numeric and NaN read 0."""
    x = text.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)


def read_exporter_csv(spark: SparkSession, path: str, ts_header: str = "Timestamp") -> DataFrame:
    """Flow-exporter CSV -> canonical record.

    Known headers are renamed; a missing or non-numeric measure reads 0; a
    missing address reads 0.0.0.0 and a missing port 0; addresses stay text.
    ``source`` is 'cicflowmeter_real'; the flow time comes from the
    ``Timestamp`` column when the file has one.
    """
    raw = spark.read.option("header", True).csv(path)
    present = {c.strip(): c for c in raw.columns}
    out = []
    for header, name in CIC_HEADER_MAP.items():
        col = F.col(f"`{present[header]}`") if header in present else F.lit(None).cast("string")
        if name in CIC_NUMERIC:
            out.append(measure(col).alias(name))
        elif name in ("src_port", "dst_port"):
            out.append(F.coalesce(col.try_cast("double").try_cast("int"), F.lit(0)).alias(name))
        elif name in ("src_ip", "dst_ip"):
            out.append(F.coalesce(F.nullif(F.trim(col), F.lit("")), F.lit("0.0.0.0")).alias(name))
        else:
            out.append(col.alias(name))
    ts = (F.try_to_timestamp(F.col(f"`{present[ts_header]}`")).cast("timestamp_ntz")
          if ts_header in present else F.current_timestamp().cast("timestamp_ntz"))
    extra = [F.col(f"`{present[h]}`").alias(snake(h)) for h in present
             if h not in CIC_HEADER_MAP and h != ts_header]
    return raw.select(ts.alias("flow_ts"), *out, F.lit("cicflowmeter_real").alias("source"), *extra)
