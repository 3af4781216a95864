"""Fixture: sensor text rendered from the flow view, the input of the parser queries.

Each renderer turns flow records into one tab-separated log line per flow in
the field layout a Zeek log kind uses, with a deterministic sprinkling of
``-`` placeholders, malformed numbers, comment lines and short lines so the
parsers' edge rules are exercised. Epoch seconds and durations are written
as ``<seconds>.<6 digits>`` so the parse round trip is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _q() -> Column:
    return F.col("flow_seq")


def _s(c: Column) -> Column:
    return c.cast("string")


def _seconds_text(us: Column) -> Column:
    whole, rest = F.floor(us / 1000000).cast("bigint"), us % 1000000
    # a format is read anew for every row: only negative and missing times need it
    return (F.when(us >= 0, F.concat(_s(whole), F.lit("."), F.lpad(_s(rest), 6, "0")))
            .otherwise(F.format_string("%d.%06d", whole, rest)))


def epoch_text(ts: Column) -> Column:
    return _seconds_text(F.unix_micros(ts.cast("timestamp")))


def micros_text(us: Column) -> Column:
    return _seconds_text(us.cast("bigint"))


def _finish(flows: DataFrame, fields: list[Column], short_keep: int) -> DataFrame:
    """Join fields with tabs; every 500th flow becomes a comment line and
    every 701st keeps only its first ``short_keep`` fields."""
    line = F.concat_ws("\t", *fields)
    short = F.concat_ws("\t", *fields[:short_keep])
    value = (F.when(_q() % 500 == 0, F.concat(F.lit("#comment\t"), _s(_q())))
             .when(_q() % 701 == 0, short)
             .otherwise(line))
    return flows.select(_q(), value.alias("value"))


def conn_lines(flows: DataFrame) -> DataFrame:
    sport = (F.when(_q() % 53 == 0, F.lit("-")).when(_q() % 83 == 0, F.lit("80.0"))
             .otherwise(_s(F.col("src_port"))))
    service = (F.when(F.col("dst_port") == 80, "http").when(F.col("dst_port") == 443, "ssl")
               .when(F.col("dst_port") == 22, "ssh").otherwise("-"))
    dur = F.when(_q() % 89 == 0, F.lit("-")).otherwise(micros_text(F.col("flow_duration")))
    state = (F.when(_q() % 4 == 0, "SF").when(_q() % 4 == 1, "S0").when(_q() % 4 == 2, "REJ")
             .otherwise("RSTO"))
    fields = [epoch_text(F.col("flow_ts")), F.concat(F.lit("C"), _s(_q())), F.col("src_ip"), sport,
              F.col("dst_ip"), _s(F.col("dst_port")), F.lower(F.col("protocol")), service, dur,
              _s(F.col("total_fwd_packets")), _s(F.col("total_backward_packets")),
              _s(F.col("total_length_fwd_packets")), _s(F.col("total_length_bwd_packets")),
              state, F.lit("-")]
    return _finish(flows, fields, 12)


def dns_lines(flows: DataFrame) -> DataFrame:
    sport = F.when(_q() % 53 == 0, F.lit("-")).otherwise(_s(F.col("src_port")))
    dport = F.when(_q() % 59 == 0, F.lit("-")).otherwise(F.lit("53"))
    qtype = F.when(_q() % 3 == 0, "A").when(_q() % 3 == 1, "AAAA").otherwise("MX")
    rcode = F.when(_q() % 5 == 0, "NXDOMAIN").otherwise("NOERROR")
    fields = [epoch_text(F.col("flow_ts")), F.concat(F.lit("D"), _s(_q())), F.col("src_ip"), sport,
              F.col("dst_ip"), dport, F.lit("udp"), _s(_q() % 65536), F.lit("0.010000"),
              F.concat(F.lit("host"), _s(_q() % 97), F.lit(".example.com")), F.lit("1"),
              F.lit("C_INTERNET"), F.lit("1"), qtype, F.lit("0"), rcode]
    # every 7th line stops after the query class (12 fields): type and code read '-'
    n = F.when(_q() % 7 == 0, 12).otherwise(16)
    line = F.when(n == 12, F.concat_ws("\t", *fields[:12])).otherwise(F.concat_ws("\t", *fields))
    value = (F.when(_q() % 500 == 0, F.concat(F.lit("#comment\t"), _s(_q())))
             .when(_q() % 701 == 0, F.concat_ws("\t", *fields[:8]))
             .otherwise(line))
    return flows.select(_q(), value.alias("value"))


def http_lines(flows: DataFrame) -> DataFrame:
    method = (F.when(_q() % 4 == 0, "GET").when(_q() % 4 == 1, "POST").when(_q() % 4 == 2, "PUT")
              .otherwise("HEAD"))
    uri = F.when(_q() % 41 == 0, F.lit("-")).otherwise(
        F.concat(F.lit("/p/"), _s(_q()), F.repeat(F.lit("x"), (_q() % 17).cast("int"))))
    status = F.when(_q() % 10 == 0, "404").otherwise("200")
    dport = F.when(_q() % 61 == 0, F.lit("-")).otherwise(_s(F.col("dst_port")))
    fields = [epoch_text(F.col("flow_ts")), F.concat(F.lit("H"), _s(_q())), F.col("src_ip"),
              _s(F.col("src_port")), F.col("dst_ip"), dport, F.lit("1"), method,
              F.concat(F.lit("site"), _s(_q() % 13), F.lit(".test")), uri, F.lit("-"), F.lit("1.1"),
              status, F.lit("OK"), F.lit("-"), F.lit("-")]
    return _finish(flows, fields, 14)


def ssl_lines(flows: DataFrame) -> DataFrame:
    dport = F.when(_q() % 61 == 0, F.lit("-")).otherwise(_s(F.col("dst_port")))
    version = F.when(_q() % 2 == 0, "TLSv12").otherwise("TLSv13")
    fields = [epoch_text(F.col("flow_ts")), F.concat(F.lit("S"), _s(_q())), F.col("src_ip"),
              _s(F.col("src_port")), F.col("dst_ip"), dport, version,
              F.lit("TLS_AES_128_GCM_SHA256"), F.lit("x25519"),
              F.concat(F.lit("svc"), _s(_q() % 19), F.lit(".example.org")), F.lit("F"), F.lit("T")]
    return _finish(flows, fields, 9)


def weird_lines(flows: DataFrame) -> DataFrame:
    src = F.when(_q() % 67 == 0, F.lit("-")).otherwise(F.col("src_ip"))
    sport = (F.when(_q() % 71 == 0, F.lit("-")).when(_q() % 73 == 0, F.lit("x1"))
             .otherwise(_s(F.col("src_port"))))
    name = (F.when(_q() % 3 == 0, "bad_TCP_checksum").when(_q() % 3 == 1, "truncated_header")
            .otherwise("dns_unmatched_msg"))
    fields = [epoch_text(F.col("flow_ts")), F.concat(F.lit("W"), _s(_q())), src, sport,
              F.col("dst_ip"), _s(F.col("dst_port")), name, F.lit("-")]
    line = F.when(_q() % 9 == 0, F.concat_ws("\t", *fields[:6])).otherwise(F.concat_ws("\t", *fields))
    value = (F.when(_q() % 500 == 0, F.concat(F.lit("#comment\t"), _s(_q())))
             .when(_q() % 701 == 0, F.concat_ws("\t", *fields[:5]))
             .otherwise(line))
    return flows.select(_q(), value.alias("value"))


RENDERERS = {"conn": conn_lines, "dns": dns_lines, "http": http_lines, "ssl": ssl_lines,
             "weird": weird_lines}
