"""Streaming flow sources bound by name.

``zeek`` and ``cicflowmeter`` read files that are complete when they appear,
each once per checkpoint; ``zeek_tail`` and ``cicflowmeter_tail`` follow files
that grow (byte offsets, ``streaming.tail``). All of them can give validated
canonical records (``canonical=True``): one schema, bad records dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.schema import CIC_HEADER_MAP, ZEEK_LOG_KINDS
from flowsieve.sources import zeek
from flowsieve.functions.validate import canonical_flows
from flowsieve.sources.csv_flows import CIC_NUMERIC, measure
from flowsieve.streaming.tail import tail_lines


# conn.log, conn.2024-01-01-00-00-00.log (rotated), conn.12:00:00-13:00:00.log.gz,
# and a folder of that name with part files
LOG_NAME_RE = r"(?:^|/)([A-Za-z0-9_]+)(?:\.[^/]*)?\.log(?:\.gz)?(?:/[^/]+)?$"


def zeek_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A folder of rotated Zeek logs; dispatch on the file name."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _zeek_records(reader.load(path).select("value", F.col("_metadata.file_path").alias("_path")))


def zeek_tail(spark: SparkSession, path: str) -> DataFrame:
    """Zeek logs that sensors are still writing."""
    return _zeek_records(tail_lines(spark, path).withColumnRenamed("path", "_path"))


def _zeek_records(lines: DataFrame) -> DataFrame:
    kind_of = F.regexp_extract(F.col("_path"), LOG_NAME_RE, 1)
    out = None
    for kind in ZEEK_LOG_KINDS:
        parsed = zeek.PARSERS[kind](lines.where(kind_of == kind).select("value"))
        out = parsed if out is None else out.unionByName(parsed, allowMissingColumns=True)
    return out


def exporter_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                    ts_header: str = "Timestamp") -> DataFrame:
    """Flow-exporter CSV files dropped into a folder, each read once."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in [ts_header, *CIC_HEADER_MAP]])
    reader = spark.readStream.schema(schema).option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _exporter_records(reader.csv(path), ts_header)


def exporter_tail(spark: SparkSession, path: str, ts_header: str = "Timestamp",
                  headers: list[str] | None = None) -> DataFrame:
    """Flow-exporter CSV files that are still written. ``headers`` names their
    columns in order (all of them, by default); header lines are left out."""
    names = headers or [ts_header, *CIC_HEADER_MAP]
    wanted = [ts_header, *CIC_HEADER_MAP]
    fields = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))))
    rows = tail_lines(spark, path).where(~F.col("value").startswith(names[0] + ",") & (F.trim("value") != ""))
    rows = rows.select(fields.alias("f")).select(*[
        (F.col(f"f.c{names.index(h)}") if h in names else F.lit(None).cast("string")).alias(h) for h in wanted])
    return _exporter_records(rows, ts_header)


def _exporter_records(raw: DataFrame, ts_header: str) -> DataFrame:
    cols = []
    for header, name in CIC_HEADER_MAP.items():
        col = F.col(f"`{header}`")
        if name in CIC_NUMERIC:
            cols.append(measure(col).alias(name))
        elif name in ("src_port", "dst_port"):
            cols.append(F.coalesce(col.try_cast("double").try_cast("int"), F.lit(0)).alias(name))
        elif name in ("src_ip", "dst_ip"):
            cols.append(F.coalesce(F.nullif(F.trim(col), F.lit("")), F.lit("0.0.0.0")).alias(name))
        else:
            cols.append(col.alias(name))
    ts = F.try_to_timestamp(F.col(f"`{ts_header}`")).cast("timestamp_ntz")
    return raw.select(ts.alias("flow_ts"), *cols, F.lit("cicflowmeter_real").alias("source"))


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType,
                   max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def flow_stream(spark: SparkSession, source_type: str, path: str, schema: T.StructType | None = None,
                max_files_per_trigger: int | None = None, canonical: bool = False) -> DataFrame:
    """Streaming DataFrame of flow records from a named source type, as the
    source gives them or (``canonical``) validated and in one schema."""
    if source_type == "zeek":
        flows = zeek_stream(spark, path, max_files_per_trigger)
    elif source_type == "zeek_tail":
        flows = zeek_tail(spark, path)
    elif source_type == "cicflowmeter":
        flows = exporter_stream(spark, path, max_files_per_trigger)
    elif source_type == "cicflowmeter_tail":
        flows = exporter_tail(spark, path)
    elif source_type == "parquet":
        if schema is None:
            raise ValueError("a parquet flow stream needs a schema")
        flows = parquet_stream(spark, path, schema, max_files_per_trigger)
    else:
        raise ValueError(f"unknown traffic source {source_type!r}")
    return canonical_flows(flows) if canonical else flows
