"""Registered queries: sensor text rendered from the flow view and parsed back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from flowsieve.functions.columns import r6
from flowsieve.session import work_dir, written
from flowsieve.sources import zeek
from flowsieve.plans.fixture_lines import RENDERERS
from flowsieve.sources.tables import flows_from_events, read_table

FLOAT_OUT = ["flow_duration", "fwd_packet_length_mean", "fwd_packet_length_max",
             "fwd_packet_length_min", "flow_bytes_s", "flow_packets_s", "flow_iat_mean", "flow_iat_std"]


def spread(spark, df):
    """Write test logs as one file per core (a sensor folder holds many files)."""
    return df.repartition(spark.sparkContext.defaultParallelism)


def spread_events(spark, sf_dir):
    """The events dealt over the cores before a line is rendered: a row group of
    the table holds a million rows, and one task would render them all."""
    return spread(spark, read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"))


# Fields that no record may have: too wide for a port, too wide for any
# integer, no number, an epoch beyond the timestamp range (fixed values).
BAD_PORTS = ["4294967296", "12345678901234567890"]
BAD_EPOCHS = ["garbage", "99999999999999.000000"]


def with_bad_records(lines, kind):
    """The rendered lines and copies of some with a field that must be refused
    (an anomaly log reads a bad port as 0, so only its time is spoiled)."""
    spoiled = [(0, v) for v in BAD_EPOCHS] + ([(3, v) for v in BAD_PORTS] if kind != "weird" else [])
    f = F.split("value", "\t", -1)
    n = F.size(f)
    bad = [F.array_join(F.concat(F.slice(f, F.lit(1), F.lit(at)), F.array(F.lit(value)),
                                 F.slice(f, F.lit(at + 2), F.greatest(n - at - 1, F.lit(0)))), "\t")
           for at, value in spoiled]
    value = F.col("value")
    some = (F.col("flow_seq") % 97 == 5) & ~value.startswith("#")
    return lines.select("flow_seq", F.explode(F.when(some, F.array(value, *bad)).otherwise(F.array(value))).alias("value"))


def _present(df):
    return df.select(*[r6(F.col(c)).alias(c) if c in FLOAT_OUT else F.col(c) for c in df.columns])


def _parse_query(kind):
    def q(spark, sf_dir):
        # written as a log file and read back, as a sensor would leave it
        path = work_dir(spark, f"{kind}-log")
        lines = with_bad_records(RENDERERS[kind](flows_from_events(spread_events(spark, sf_dir))), kind)
        lines.select("value").write.mode("overwrite").text(path)
        return _present(zeek.PARSERS[kind](spark.read.text(path)))
    q.__name__ = f"q_{kind}_parse"
    return q


q_conn_parse = _parse_query("conn")
q_dns_parse = _parse_query("dns")
q_http_parse = _parse_query("http")
q_ssl_parse = _parse_query("ssl")
q_weird_parse = _parse_query("weird")


def write_zeek_folder(spark, sf_dir) -> str:
    """Write the five rendered logs (and one unknown kind) as a log folder."""
    path = work_dir(spark, "zeek-logs")
    flows = flows_from_events(written(spread_events(spark, sf_dir), "spread-events"))   # dealt once for the six logs
    for kind, render in RENDERERS.items():
        render(flows).select("value").write.mode("overwrite").text(f"{path}/{kind}.log")
    # a log kind without a parser is ignored by the folder scan
    (flows.select(F.concat(F.lit("F"), F.col("flow_seq").cast("string")).alias("value"))
     .write.mode("overwrite").text(f"{path}/files.log"))
    return path


def q_zeek_union(spark, sf_dir):
    path = write_zeek_folder(spark, sf_dir)
    return _present(zeek.read_zeek_dir(spark, path))


def q_zeek_tsv_scan(spark, sf_dir):
    """Header-driven scan: conn lines under a ``#fields`` header naming the
    first 15 columns; every value stays text."""
    path = work_dir(spark, "zeek-tsv")
    lines = RENDERERS["conn"](flows_from_events(spread_events(spark, sf_dir))).select("value")
    head = pa.RecordBatch.from_pydict({"value": ["#fields\t" + "\t".join(TSV_FIELDS)]})

    def headed(batches):
        yield head
        yield from batches

    lines.mapInArrow(headed, "value string").write.mode("overwrite").text(path)   # every file has its header
    return zeek.read_zeek_tsv(spark, path).drop("source_file")


# Column names of the conn layout (fixed values).
TSV_FIELDS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service",
              "duration", "orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes", "conn_state", "local_orig"]


def q_conn_header_parse(spark, sf_dir):
    """Typed connection records from files whose ``#fields`` line changes half
    way: the second half of each file has its fields in another order."""
    lines = with_bad_records(RENDERERS["conn"](flows_from_events(spread_events(spark, sf_dir))), "conn")
    turned = TSV_FIELDS[::-1]
    parts = F.split("value", "\t", -1)
    # lines that are short or no records keep their order, and are refused in either
    swapped = F.when(F.size(parts) == len(TSV_FIELDS), F.array_join(F.reverse(parts), "\t")).otherwise(F.col("value"))
    half = F.col("flow_seq") % 2
    files = spark.sparkContext.defaultParallelism
    # one sort key: 0 and 2 for the headers, 1 and 3 for the lines behind them
    body = lines.select(F.pmod(F.xxhash64("flow_seq"), F.lit(files)).cast("int").alias("_file"),
                        (half * 2 + 1).cast("int").alias("_at"),
                        F.when(half == 0, F.col("value")).otherwise(swapped).alias("value"))
    heads = spark.range(files).select(F.col("id").cast("int").alias("_file"), F.explode(F.array(*[
        F.struct(F.lit(i * 2).alias("_at"), F.lit("\t".join(["#fields", *names])).alias("value"))
        for i, names in enumerate((TSV_FIELDS, turned))])).alias("h")).select("_file", "h.*")
    path = work_dir(spark, "conn-headers")
    (body.unionByName(heads).repartitionById(files, F.col("_file"))          # every task writes one file
     .sortWithinPartitions("_at").select("value").write.text(path))
    return _present(zeek.read_zeek_log(spark, path, "conn"))
