"""Zeek sensor logs: positional line parsers, folder scan, header-driven scan.

Parsers take a DataFrame with one log line per row in column ``value`` (as
``spark.read.text`` gives) and return flow records. A line is dropped when
it is blank or a ``#`` comment, has fewer fields than its kind needs, or a
field that must be a number is neither ``-`` nor a number (the record-level
"cast failed -> drop" rule). Everything is built-in expressions; no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.schema import (HTTP_DURATION_US, HTTP_REQUEST_OVERHEAD, HTTP_RESPONSE_BYTES,
                              MEASURE_FIELDS, ZEEK_CONSTANTS, ZEEK_DEFAULT_PORT, ZEEK_LOG_KINDS,
                              ZEEK_MIN_FIELDS)
from flowsieve.session import written

INT_RE = r"^[+-]?[0-9]+$"
DIGITS_RE = r"^[0-9]+$"
FLOAT_RE = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
EDGE_WS_RE = r"^\s+|\s+$"

MEASURE_TYPES = {
    "flow_duration": "double", "total_fwd_packets": "bigint", "total_backward_packets": "bigint",
    "total_length_fwd_packets": "bigint", "total_length_bwd_packets": "bigint",
    "fwd_packet_length_mean": "double", "fwd_packet_length_max": "double",
    "fwd_packet_length_min": "double", "flow_bytes_s": "double", "flow_packets_s": "double",
    "flow_iat_mean": "double", "flow_iat_std": "double",
}


def _once(c: Column) -> Column:
    """The value, computed once a row: conditions on it are not pushed below it,
    where each of its uses would be computed anew."""
    return F.explode(F.array(c))


def _content_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Strip line ends; drop blank and ``#`` lines; split on tabs."""
    text = F.regexp_replace(F.col(col), EDGE_WS_RE, "")
    keep = [F.col(c) for c in lines.columns if c != col]
    return (lines.select(*keep, _once(text).alias("_line"))
            .where((F.length("_line") > 0) & ~F.col("_line").startswith("#"))
            .select(*keep, _once(F.split("_line", "\t", -1)).alias("_f")))


def f(i: int) -> Column:
    return F.get(F.col("_f"), i)


def _int_field(i: int, default: int, dtype: str = "bigint") -> tuple[Column, Column]:
    """(value, ok): '-' gives ``default``; otherwise must be an integer that
    ``dtype`` holds."""
    raw = f(i)
    val = F.when(raw == "-", F.lit(default).cast(dtype)).otherwise(raw.try_cast(dtype))
    return val, ((raw == "-") | raw.rlike(INT_RE)) & val.isNotNull()


def _timestamp(i: int = 0) -> tuple[Column, Column]:
    """Epoch seconds text -> timestamp (UTC wall clock), exact to the microsecond."""
    raw = f(i)
    micros = (raw.try_cast("decimal(20,6)") * F.lit(1000000)).try_cast("bigint")
    return F.timestamp_micros(micros).cast("timestamp_ntz"), raw.rlike(FLOAT_RE) & micros.isNotNull()


def _constants(kind: str) -> list[Column]:
    return [F.lit(v).cast(MEASURE_TYPES[n]).alias(n) for n, v in zip(MEASURE_FIELDS, ZEEK_CONSTANTS[kind])]


def _finish(parsed: DataFrame, oks: list[Column]) -> DataFrame:
    cond = oks[0]
    for o in oks[1:]:
        cond = cond & o
    return parsed.where(F.coalesce(cond, F.lit(False)))


def parse_conn(lines: DataFrame, col: str = "value") -> DataFrame:
    """Connection log: 4-tuple, duration, packet and byte counts, state;
    rates per second (0 when the duration is 0), length and IAT estimates."""
    base = _content_lines(lines, col).where(F.size("_f") >= ZEEK_MIN_FIELDS["conn"])
    ts, ts_ok = _timestamp()
    d = ZEEK_DEFAULT_PORT["conn"]
    sport, sport_ok = _int_field(3, d, "int")
    dport, dport_ok = _int_field(5, d, "int")
    pk = [_int_field(i, 0) for i in (9, 10, 11, 12)]
    dur_raw = f(8)
    dur_ok = (dur_raw == "-") | dur_raw.rlike(FLOAT_RE)
    dur = F.when(dur_raw == "-", F.lit(0.0)).otherwise(dur_raw.try_cast("double") * F.lit(1000000.0))
    stage = base.select(
        "_f", ts.alias("flow_ts"), f(2).alias("src_ip"), sport.alias("src_port"),
        f(4).alias("dst_ip"), dport.alias("dst_port"), f(6).alias("protocol"),
        dur.alias("flow_duration"),
        pk[0][0].alias("total_fwd_packets"), pk[1][0].alias("total_backward_packets"),
        pk[2][0].alias("total_length_fwd_packets"), pk[3][0].alias("total_length_bwd_packets"),
        F.lit("conn").alias("zeek_log_type"), f(1).alias("zeek_uid"),
        F.coalesce(f(13), F.lit("-")).alias("connection_state"),
        (ts_ok & sport_ok & dport_ok & dur_ok & pk[0][1] & pk[1][1] & pk[2][1] & pk[3][1]).alias("_ok"))
    dur_c = F.col("flow_duration")
    pkts = F.col("total_fwd_packets") + F.col("total_backward_packets")
    byts = F.col("total_length_fwd_packets") + F.col("total_length_bwd_packets")
    secs = dur_c / F.lit(1000000.0)
    mean = F.when(F.col("total_fwd_packets") > 0,
                  F.col("total_length_fwd_packets") / F.col("total_fwd_packets").cast("double")
                  ).otherwise(F.lit(0.0))
    iat = dur_c / F.greatest(pkts, F.lit(1)).cast("double")
    out = stage.select(
        "*",
        F.when(dur_c > 0, byts / secs).otherwise(F.lit(0.0)).alias("flow_bytes_s"),
        F.when(dur_c > 0, pkts / secs).otherwise(F.lit(0.0)).alias("flow_packets_s"),
        mean.alias("fwd_packet_length_mean"),
        (mean * 1.5).alias("fwd_packet_length_max"),
        F.greatest(F.lit(20.0), mean * 0.5).alias("fwd_packet_length_min"),
        iat.alias("flow_iat_mean"),
        (iat * 0.3).alias("flow_iat_std"))
    return _finish(out, [F.col("_ok")]).drop("_f", "_ok")


def _endpoint(kind: str):
    d = ZEEK_DEFAULT_PORT[kind]
    sport, sok = _int_field(3, d, "int")
    dport, dok = _int_field(5, d, "int")
    return sport, dport, sok & dok


def parse_dns(lines: DataFrame, col: str = "value") -> DataFrame:
    """DNS log: query, type name, response code; fixed flow measures."""
    base = _content_lines(lines, col).where(F.size("_f") >= ZEEK_MIN_FIELDS["dns"])
    ts, ts_ok = _timestamp()
    sport, dport, pok = _endpoint("dns")
    out = base.select(
        ts.alias("flow_ts"), f(2).alias("src_ip"), sport.alias("src_port"), f(4).alias("dst_ip"),
        dport.alias("dst_port"), f(6).alias("protocol"), F.lit("dns").alias("zeek_log_type"),
        f(1).alias("zeek_uid"),
        F.coalesce(f(9), F.lit("-")).alias("dns_query"),
        F.coalesce(f(13), F.lit("-")).alias("dns_qtype"),
        F.coalesce(f(15), F.lit("-")).alias("dns_rcode"),
        *_constants("dns"), (ts_ok & pok).alias("_ok"))
    return _finish(out, [F.col("_ok")]).drop("_ok")


def parse_http(lines: DataFrame, col: str = "value") -> DataFrame:
    """HTTP log: method, host, URI, status; request size = len(URI) + 200."""
    base = _content_lines(lines, col).where(F.size("_f") >= ZEEK_MIN_FIELDS["http"])
    ts, ts_ok = _timestamp()
    sport, dport, pok = _endpoint("http")
    uri = F.coalesce(f(9), F.lit("-"))
    req = F.length(uri).cast("bigint") + F.lit(HTTP_REQUEST_OVERHEAD)
    out = base.select(
        ts.alias("flow_ts"), f(2).alias("src_ip"), sport.alias("src_port"), f(4).alias("dst_ip"),
        dport.alias("dst_port"), F.lit("TCP").alias("protocol"), F.lit("http").alias("zeek_log_type"),
        f(1).alias("zeek_uid"),
        F.coalesce(f(7), F.lit("-")).alias("http_method"),
        F.coalesce(f(8), F.lit("-")).alias("http_host"),
        uri.alias("http_uri"),
        F.coalesce(f(12), F.lit("-")).alias("http_status_code"),
        F.lit(float(HTTP_DURATION_US)).alias("flow_duration"),
        F.lit(3).cast("bigint").alias("total_fwd_packets"),
        F.lit(5).cast("bigint").alias("total_backward_packets"),
        req.alias("total_length_fwd_packets"),
        F.lit(HTTP_RESPONSE_BYTES).cast("bigint").alias("total_length_bwd_packets"),
        (req / F.lit(3.0)).alias("fwd_packet_length_mean"),
        req.cast("double").alias("fwd_packet_length_max"),
        F.lit(64.0).alias("fwd_packet_length_min"),
        ((req + F.lit(HTTP_RESPONSE_BYTES)) / F.lit(0.5)).alias("flow_bytes_s"),
        F.lit(16.0).alias("flow_packets_s"),
        F.lit(62500.0).alias("flow_iat_mean"),
        F.lit(20000.0).alias("flow_iat_std"),
        (ts_ok & pok).alias("_ok"))
    return _finish(out, [F.col("_ok")]).drop("_ok")


def parse_ssl(lines: DataFrame, col: str = "value") -> DataFrame:
    """TLS log: version and server name; fixed flow measures."""
    base = _content_lines(lines, col).where(F.size("_f") >= ZEEK_MIN_FIELDS["ssl"])
    ts, ts_ok = _timestamp()
    sport, dport, pok = _endpoint("ssl")
    out = base.select(
        ts.alias("flow_ts"), f(2).alias("src_ip"), sport.alias("src_port"), f(4).alias("dst_ip"),
        dport.alias("dst_port"), F.lit("TCP").alias("protocol"), F.lit("ssl").alias("zeek_log_type"),
        f(1).alias("zeek_uid"),
        F.coalesce(f(6), F.lit("-")).alias("ssl_version"),
        F.coalesce(f(9), F.lit("-")).alias("ssl_server_name"),
        *_constants("ssl"), (ts_ok & pok).alias("_ok"))
    return _finish(out, [F.col("_ok")]).drop("_ok")


def parse_weird(lines: DataFrame, col: str = "value") -> DataFrame:
    """Anomaly log: name and notice flag; a non-digit port reads as 0 and a
    missing address as 0.0.0.0; fixed flow measures."""
    base = _content_lines(lines, col).where(F.size("_f") >= ZEEK_MIN_FIELDS["weird"])
    ts, ts_ok = _timestamp()

    def port(i):
        raw = f(i)
        return F.coalesce(F.when(raw.rlike(DIGITS_RE), raw.try_cast("int")), F.lit(0))

    def addr(i):
        raw = f(i)
        return F.when(raw == "-", F.lit("0.0.0.0")).otherwise(raw)

    out = base.select(
        ts.alias("flow_ts"), addr(2).alias("src_ip"), port(3).alias("src_port"),
        addr(4).alias("dst_ip"), port(5).alias("dst_port"), F.lit("TCP").alias("protocol"),
        F.lit("weird").alias("zeek_log_type"), F.coalesce(f(1), F.lit("-")).alias("zeek_uid"),
        F.coalesce(f(6), F.lit("unknown")).alias("weird_name"),
        F.lit(True).alias("weird_notice"),
        *_constants("weird"), ts_ok.alias("_ok"))
    return _finish(out, [F.col("_ok")]).drop("_ok")


PARSERS = {"conn": parse_conn, "dns": parse_dns, "http": parse_http, "ssl": parse_ssl,
           "weird": parse_weird}


# Where the parsers expect the fields that a header names.
_ENDS = {0: "ts", 1: "uid", 2: "id.orig_h", 3: "id.orig_p", 4: "id.resp_h", 5: "id.resp_p"}
HEADER_FIELDS = {
    "conn": _ENDS | {6: "proto", 7: "service", 8: "duration", 9: "orig_pkts", 10: "resp_pkts", 11: "orig_bytes",
                     12: "resp_bytes", 13: "conn_state", 14: "local_orig"},
    "dns": _ENDS | {6: "proto", 9: "query", 13: "qtype_name", 15: "rcode_name"},
    "http": _ENDS | {7: "method", 8: "host", 9: "uri", 12: "status_code"},
    "ssl": _ENDS | {6: "version", 9: "server_name"},
    "weird": _ENDS | {6: "name"},
}
MANY_FILES = 100_000


def header_lines(spark, paths, kind: str) -> DataFrame:
    """The content lines of sensor logs in the order of fields that the parser
    of their kind expects (column ``value``).

    A ``#fields`` line holds for the lines behind it in its file, up to the next
    one; a line before any header, or in a file without one, stays as it is. A
    field that a header does not name reads as ``-``; a line with fewer fields
    than its header is dropped. Lines are placed by file, byte range of the split
    and order inside it, so a header in one split of a large file reaches the
    lines of the others.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"), at.alias("_at"))
    named = raw.where(F.col("value").startswith("#fields")).select(
        "_file", "_at", F.split(F.regexp_replace("value", EDGE_WS_RE, ""), "\t", -1).alias("_all"))
    headers = (named.select("_file", F.struct("_at", F.slice("_all", F.lit(2), F.size("_all")).alias("names")).alias("h"))
               .groupBy("_file").agg(F.sort_array(F.collect_list("h")).alias("_headers")))   # the headers of a file
    headers = written(headers, "headers")   # found once: the count and the join would each read every line for them
    if headers.limit(MANY_FILES + 1).count() <= MANY_FILES:
        headers = F.broadcast(headers)
    lines = _content_lines(raw).join(headers, "_file", "left")
    valid = F.filter("_headers", lambda h: h["_at"] < F.col("_at"))
    names = F.when(F.size(valid) > 0, F.element_at(valid, -1)["names"])
    places = HEADER_FIELDS[kind]
    width = max(ZEEK_MIN_FIELDS[kind], max(places) + 1)

    def field(i: int) -> Column:
        if i not in places:
            return F.lit("-")
        found = F.array_position(F.col("_names"), F.lit(places[i])).cast("int")
        return F.coalesce(F.when(found > 0, F.get(F.col("_f"), found - 1)), F.lit("-"))
    placed = lines.withColumn("_names", names).where(F.col("_names").isNull() | (F.size("_f") >= F.size("_names")))
    ordered = F.array(*[field(i) for i in range(width)])
    return placed.select(F.array_join(F.when(F.col("_names").isNull(), F.col("_f")).otherwise(ordered), "\t").alias("value"))


def read_zeek_log(spark, paths, kind: str) -> DataFrame:
    """Flow records of one kind of sensor log, by its headers where it has them."""
    return PARSERS[kind](header_lines(spark, paths, kind))


def read_zeek_dir(spark, path: str) -> DataFrame:
    """Parse the five known kinds of a log folder (a file ``conn.log`` or a
    folder ``conn.log/`` of part files, ...) by position, ignore other kinds,
    union by name. Each kind reads only its own path; absent kinds are skipped.
    """
    from pyspark.errors import AnalysisException

    out = None
    for kind in ZEEK_LOG_KINDS:
        try:
            lines = spark.read.text(f"{path.rstrip('/')}/{kind}.log")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue                         # no log of this kind
        parsed = PARSERS[kind](lines)
        out = parsed if out is None else out.unionByName(parsed, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no known log kind under {path}")
    return out


def read_zeek_tsv(spark, paths) -> DataFrame:
    """Header-driven scan: each file's ``#fields`` line names its columns (the
    last one, where it has several); all values stay strings; files with
    different headers are unioned by name (a missing column is NULL).

    The distinct headers are brought to the driver, to learn the names of the
    output columns; the header of each file is joined to its lines.
    """
    raw = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("_file"),
                                      F.col("_metadata.file_block_start").alias("_block"))
    headers = (raw.where(F.col("value").startswith("#fields"))
               .select("_file", F.split(F.regexp_replace("value", EDGE_WS_RE, ""), "\t", -1).alias("_all"),
                       F.struct(F.col("_block"), F.monotonically_increasing_id()).alias("_at"))
               .groupBy("_file").agg(F.max_by("_all", "_at").alias("_all"))
               .select("_file", F.slice("_all", F.lit(2), F.size("_all")).alias("_cols")))
    names = list(dict.fromkeys(c for r in headers.select("_cols").distinct().orderBy("_cols").collect()
                               for c in r["_cols"]))
    data = _content_lines(raw.drop("_block")).join(headers, "_file")
    cols = [F.get(F.col("_f"), F.array_position(F.col("_cols"), F.lit(n)).cast("int") - 1).alias(n)
            for n in names]
    return data.select(*cols, F.col("_file").alias("source_file"))
