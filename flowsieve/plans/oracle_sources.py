"""DuckDB statements for the sensor-text round trips (render, then parse)."""

from flowsieve.plans.oracle_base import FLOWS_CTE

TAB = "chr(9)"
INT_RE = "'^[+-]?[0-9]+$'"
FLOAT_RE = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
EPOCH = "printf('%d.%06d', epoch_us(flow_ts) // 1000000, epoch_us(flow_ts) % 1000000)"


def _micros(x):
    return f"printf('%d.%06d', CAST({x} AS BIGINT) // 1000000, CAST({x} AS BIGINT) % 1000000)"


def _s(x):
    return f"CAST({x} AS VARCHAR)"


def _cws(fields):
    return f"concat_ws({TAB}, " + ", ".join(fields) + ")"


def _lines(fields, short_keep, line_expr=None, short_expr=None):
    line = line_expr or _cws(fields)
    short = short_expr or _cws(fields[:short_keep])
    return (f"CASE WHEN flow_seq % 500 = 0 THEN '#comment' || {TAB} || {_s('flow_seq')} "
            f"WHEN flow_seq % 701 = 0 THEN {short} ELSE {line} END")


CONN_FIELDS = [EPOCH, "'C' || " + _s("flow_seq"), "src_ip",
               f"CASE WHEN flow_seq % 53 = 0 THEN '-' WHEN flow_seq % 83 = 0 THEN '80.0' ELSE {_s('src_port')} END",
               "dst_ip", _s("dst_port"), "lower(protocol)",
               "CASE WHEN dst_port = 80 THEN 'http' WHEN dst_port = 443 THEN 'ssl' WHEN dst_port = 22 THEN 'ssh' ELSE '-' END",
               f"CASE WHEN flow_seq % 89 = 0 THEN '-' ELSE {_micros('flow_duration')} END",
               _s("total_fwd_packets"), _s("total_backward_packets"), _s("total_length_fwd_packets"),
               _s("total_length_bwd_packets"),
               "CASE flow_seq % 4 WHEN 0 THEN 'SF' WHEN 1 THEN 'S0' WHEN 2 THEN 'REJ' ELSE 'RSTO' END", "'-'"]

DNS_FIELDS = [EPOCH, "'D' || " + _s("flow_seq"), "src_ip",
              f"CASE WHEN flow_seq % 53 = 0 THEN '-' ELSE {_s('src_port')} END", "dst_ip",
              "CASE WHEN flow_seq % 59 = 0 THEN '-' ELSE '53' END", "'udp'", _s("flow_seq % 65536"),
              "'0.010000'", "'host' || " + _s("flow_seq % 97") + " || '.example.com'", "'1'",
              "'C_INTERNET'", "'1'", "CASE flow_seq % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'AAAA' ELSE 'MX' END",
              "'0'", "CASE WHEN flow_seq % 5 = 0 THEN 'NXDOMAIN' ELSE 'NOERROR' END"]

HTTP_FIELDS = [EPOCH, "'H' || " + _s("flow_seq"), "src_ip", _s("src_port"), "dst_ip",
               f"CASE WHEN flow_seq % 61 = 0 THEN '-' ELSE {_s('dst_port')} END", "'1'",
               "CASE flow_seq % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'HEAD' END",
               "'site' || " + _s("flow_seq % 13") + " || '.test'",
               "CASE WHEN flow_seq % 41 = 0 THEN '-' ELSE '/p/' || " + _s("flow_seq")
               + " || repeat('x', CAST(flow_seq % 17 AS INTEGER)) END",
               "'-'", "'1.1'", "CASE WHEN flow_seq % 10 = 0 THEN '404' ELSE '200' END", "'OK'", "'-'", "'-'"]

SSL_FIELDS = [EPOCH, "'S' || " + _s("flow_seq"), "src_ip", _s("src_port"), "dst_ip",
              f"CASE WHEN flow_seq % 61 = 0 THEN '-' ELSE {_s('dst_port')} END",
              "CASE WHEN flow_seq % 2 = 0 THEN 'TLSv12' ELSE 'TLSv13' END",
              "'TLS_AES_128_GCM_SHA256'", "'x25519'", "'svc' || " + _s("flow_seq % 19") + " || '.example.org'",
              "'F'", "'T'"]

WEIRD_FIELDS = [EPOCH, "'W' || " + _s("flow_seq"),
                "CASE WHEN flow_seq % 67 = 0 THEN '-' ELSE src_ip END",
                f"CASE WHEN flow_seq % 71 = 0 THEN '-' WHEN flow_seq % 73 = 0 THEN 'x1' ELSE {_s('src_port')} END",
                "dst_ip", _s("dst_port"),
                "CASE flow_seq % 3 WHEN 0 THEN 'bad_TCP_checksum' WHEN 1 THEN 'truncated_header' ELSE 'dns_unmatched_msg' END",
                "'-'"]


def render_sql(kind):
    if kind == "conn":
        v = _lines(CONN_FIELDS, 12)
    elif kind == "dns":
        line = f"CASE WHEN flow_seq % 7 = 0 THEN {_cws(DNS_FIELDS[:12])} ELSE {_cws(DNS_FIELDS)} END"
        v = _lines(DNS_FIELDS, 8, line_expr=line)
    elif kind == "http":
        v = _lines(HTTP_FIELDS, 14)
    elif kind == "ssl":
        v = _lines(SSL_FIELDS, 9)
    else:
        line = f"CASE WHEN flow_seq % 9 = 0 THEN {_cws(WEIRD_FIELDS[:6])} ELSE {_cws(WEIRD_FIELDS)} END"
        v = _lines(WEIRD_FIELDS, 5, line_expr=line)
    return f"SELECT flow_seq, {v} AS value FROM flows"


def f(i):
    return f"f[{i + 1}]"


def _int(i, default):
    return (f"(CASE WHEN {f(i)} = '-' THEN {default} ELSE TRY_CAST({f(i)} AS BIGINT) END)",
            f"({f(i)} = '-' OR regexp_matches({f(i)}, {INT_RE}))")


TS = f"make_timestamp(CAST(TRY_CAST({f(0)} AS DECIMAL(20,6)) * 1000000 AS BIGINT))"
TS_OK = f"regexp_matches({f(0)}, {FLOAT_RE})"


def _split(kind, min_fields):
    return f"""
, {kind}_raw AS ({render_sql(kind)})
, {kind}_f AS (SELECT string_split(line, {TAB}) AS f
               FROM (SELECT regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS line FROM {kind}_raw)
               WHERE length(line) > 0 AND NOT starts_with(line, '#'))
, {kind}_g AS (SELECT * FROM {kind}_f WHERE len(f) >= {min_fields})"""


def _const(vals):
    names = ["flow_duration", "total_fwd_packets", "total_backward_packets",
             "total_length_fwd_packets", "total_length_bwd_packets", "fwd_packet_length_mean",
             "fwd_packet_length_max", "fwd_packet_length_min", "flow_bytes_s", "flow_packets_s",
             "flow_iat_mean", "flow_iat_std"]
    types = ["DOUBLE", "BIGINT", "BIGINT", "BIGINT", "BIGINT", "DOUBLE", "DOUBLE", "DOUBLE", "DOUBLE",
             "DOUBLE", "DOUBLE", "DOUBLE"]
    return ", ".join(f"CAST({v} AS {t}) AS {n}" for v, t, n in zip(vals, types, names))


def conn_cte():
    sport, sok = _int(3, 0)
    dport, dok = _int(5, 0)
    ints = [_int(i, 0) for i in (9, 10, 11, 12)]
    dur_ok = f"({f(8)} = '-' OR regexp_matches({f(8)}, {FLOAT_RE}))"
    dur = f"(CASE WHEN {f(8)} = '-' THEN 0.0 ELSE TRY_CAST({f(8)} AS DOUBLE) * 1000000.0 END)"
    ok = " AND ".join([TS_OK, sok, dok, dur_ok] + [o for _, o in ints])
    return _split("conn", 15) + f"""
, conn_s AS (SELECT {TS} AS flow_ts, {f(2)} AS src_ip, CAST({sport} AS INTEGER) AS src_port,
                    {f(4)} AS dst_ip, CAST({dport} AS INTEGER) AS dst_port, {f(6)} AS protocol,
                    {dur} AS flow_duration, {ints[0][0]} AS total_fwd_packets,
                    {ints[1][0]} AS total_backward_packets, {ints[2][0]} AS total_length_fwd_packets,
                    {ints[3][0]} AS total_length_bwd_packets, 'conn' AS zeek_log_type,
                    {f(1)} AS zeek_uid, coalesce({f(13)}, '-') AS connection_state
             FROM conn_g WHERE coalesce({ok}, false))
, conn_p AS (SELECT *,
       CASE WHEN flow_duration > 0 THEN (total_length_fwd_packets + total_length_bwd_packets)
            / (flow_duration / 1000000.0) ELSE 0.0 END AS flow_bytes_s,
       CASE WHEN flow_duration > 0 THEN (total_fwd_packets + total_backward_packets)
            / (flow_duration / 1000000.0) ELSE 0.0 END AS flow_packets_s,
       CASE WHEN total_fwd_packets > 0 THEN total_length_fwd_packets / CAST(total_fwd_packets AS DOUBLE)
            ELSE 0.0 END AS fwd_packet_length_mean,
       flow_duration / CAST(greatest(total_fwd_packets + total_backward_packets, 1) AS DOUBLE) AS flow_iat_mean
     FROM conn_s)
, conn AS (SELECT * EXCLUDE (flow_iat_mean), fwd_packet_length_mean * 1.5 AS fwd_packet_length_max,
                  greatest(20.0, fwd_packet_length_mean * 0.5) AS fwd_packet_length_min,
                  flow_iat_mean, flow_iat_mean * 0.3 AS flow_iat_std FROM conn_p)"""


def _ep(default):
    sport, sok = _int(3, default)
    dport, dok = _int(5, default)
    return (f"CAST({sport} AS INTEGER) AS src_port", f"CAST({dport} AS INTEGER) AS dst_port",
            f"{sok} AND {dok}")


def dns_cte():
    sp, dp, ok = _ep(53)
    return _split("dns", 10) + f"""
, dns AS (SELECT {TS} AS flow_ts, {f(2)} AS src_ip, {sp}, {f(4)} AS dst_ip, {dp}, {f(6)} AS protocol,
                 'dns' AS zeek_log_type, {f(1)} AS zeek_uid, coalesce({f(9)}, '-') AS dns_query,
                 coalesce({f(13)}, '-') AS dns_qtype, coalesce({f(15)}, '-') AS dns_rcode,
                 {_const([100000, 1, 1, 64, 128, 64, 64, 64, 1920, 20, 50000, 10000])}
          FROM dns_g WHERE coalesce({TS_OK} AND {ok}, false))"""


def http_cte():
    sp, dp, ok = _ep(80)
    uri = f"coalesce({f(9)}, '-')"
    req = f"(CAST(length({uri}) AS BIGINT) + 200)"
    return _split("http", 15) + f"""
, http AS (SELECT {TS} AS flow_ts, {f(2)} AS src_ip, {sp}, {f(4)} AS dst_ip, {dp}, 'TCP' AS protocol,
                  'http' AS zeek_log_type, {f(1)} AS zeek_uid, coalesce({f(7)}, '-') AS http_method,
                  coalesce({f(8)}, '-') AS http_host, {uri} AS http_uri,
                  coalesce({f(12)}, '-') AS http_status_code,
                  CAST(500000 AS DOUBLE) AS flow_duration, CAST(3 AS BIGINT) AS total_fwd_packets,
                  CAST(5 AS BIGINT) AS total_backward_packets, {req} AS total_length_fwd_packets,
                  CAST(1500 AS BIGINT) AS total_length_bwd_packets,
                  {req} / 3.0 AS fwd_packet_length_mean, CAST({req} AS DOUBLE) AS fwd_packet_length_max,
                  CAST(64 AS DOUBLE) AS fwd_packet_length_min, ({req} + 1500) / 0.5 AS flow_bytes_s,
                  CAST(16 AS DOUBLE) AS flow_packets_s, CAST(62500 AS DOUBLE) AS flow_iat_mean,
                  CAST(20000 AS DOUBLE) AS flow_iat_std
           FROM http_g WHERE coalesce({TS_OK} AND {ok}, false))"""


def ssl_cte():
    sp, dp, ok = _ep(443)
    return _split("ssl", 10) + f"""
, ssl AS (SELECT {TS} AS flow_ts, {f(2)} AS src_ip, {sp}, {f(4)} AS dst_ip, {dp}, 'TCP' AS protocol,
                 'ssl' AS zeek_log_type, {f(1)} AS zeek_uid, coalesce({f(6)}, '-') AS ssl_version,
                 coalesce({f(9)}, '-') AS ssl_server_name,
                 {_const([2000000, 4, 4, 800, 3000, 200, 400, 100, 1900, 4, 250000, 100000])}
          FROM ssl_g WHERE coalesce({TS_OK} AND {ok}, false))"""


def weird_cte():
    def port(i):
        return (f"CASE WHEN {f(i)} <> '-' AND regexp_matches({f(i)}, '^[0-9]+$') "
                f"THEN TRY_CAST({f(i)} AS INTEGER) ELSE 0 END")

    def addr(i):
        return f"CASE WHEN {f(i)} = '-' THEN '0.0.0.0' ELSE {f(i)} END"

    return _split("weird", 6) + f"""
, weird AS (SELECT {TS} AS flow_ts, {addr(2)} AS src_ip, {port(3)} AS src_port, {addr(4)} AS dst_ip,
                   {port(5)} AS dst_port, 'TCP' AS protocol, 'weird' AS zeek_log_type,
                   coalesce({f(1)}, '-') AS zeek_uid, coalesce({f(6)}, 'unknown') AS weird_name,
                   true AS weird_notice,
                   {_const([10000, 1, 0, 40, 0, 40, 40, 40, 4000, 100, 10000, 1000])}
            FROM weird_g WHERE coalesce({TS_OK}, false))"""


CTES = {"conn": conn_cte, "dns": dns_cte, "http": http_cte, "ssl": ssl_cte, "weird": weird_cte}

FLOAT_OUT = ["flow_duration", "fwd_packet_length_mean", "fwd_packet_length_max",
             "fwd_packet_length_min", "flow_bytes_s", "flow_packets_s", "flow_iat_mean", "flow_iat_std"]


def _present(rel):
    return (f"SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in FLOAT_OUT)
            + f") FROM {rel}")


def parse_sql(kind):
    return "WITH " + FLOWS_CTE + CTES[kind]() + "\n" + _present(kind)


def union_sql():
    ctes = "".join(CTES[k]() for k in ["conn", "dns", "http", "ssl", "weird"])
    body = ("SELECT * FROM conn UNION ALL BY NAME SELECT * FROM dns UNION ALL BY NAME SELECT * FROM http "
            "UNION ALL BY NAME SELECT * FROM ssl UNION ALL BY NAME SELECT * FROM weird")
    return "WITH " + FLOWS_CTE + ctes + f"\n, u AS ({body})\n" + _present("u")


TSV_FIELDS = ["ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service",
              "duration", "orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes", "conn_state", "local_orig"]


def tsv_sql():
    cols = ", ".join(f'{f(i)} AS "{n}"' for i, n in enumerate(TSV_FIELDS))
    return ("WITH " + FLOWS_CTE + f"""
, conn_raw AS ({render_sql("conn")})
, t AS (SELECT string_split(line, {TAB}) AS f
        FROM (SELECT regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS line FROM conn_raw)
        WHERE length(line) > 0 AND NOT starts_with(line, '#'))
SELECT {cols} FROM t""")


ORACLE_SOURCES = {
    "conn_parse": parse_sql("conn"),
    "conn_header_parse": parse_sql("conn"),
    "dns_parse": parse_sql("dns"),
    "http_parse": parse_sql("http"),
    "ssl_parse": parse_sql("ssl"),
    "weird_parse": parse_sql("weird"),
    "zeek_union": union_sql(),
    "zeek_tsv_scan": tsv_sql(),
}
