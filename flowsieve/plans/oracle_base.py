"""SQL text shared by the DuckDB oracle queries.

The oracle is an independent statement of each query's result in plain SQL
over the driver's parquet views; it is used only by the correctness gate.
"""

FLOWS_CTE = """
flows AS (
  SELECT event_id AS flow_seq,
         ts AS flow_ts,
         '10.0.' || CAST(user_id % 4 AS VARCHAR) || '.' || CAST(user_id % 250 AS VARCHAR) AS src_ip,
         '192.168.' || CAST(event_id % 8 AS VARCHAR) || '.' || CAST((event_id * 31) % 250 AS VARCHAR) AS dst_ip,
         CAST((event_id * 7919) % 65536 AS INTEGER) AS src_port,
         CAST(CASE event_type WHEN 'view' THEN 80 WHEN 'click' THEN 443 WHEN 'signup' THEN 22
                   WHEN 'purchase' THEN 8080 ELSE (event_id * 104729) % 65536 END AS INTEGER) AS dst_port,
         CASE event_id % 3 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE 'ICMP' END AS protocol,
         round(value * 10000) AS flow_duration,
         (event_id * 13) % 41 AS total_fwd_packets,
         (event_id * 17) % 23 AS total_backward_packets,
         ((event_id * 13) % 41) * 60 AS total_length_fwd_packets,
         ((event_id * 17) % 23) * 52 AS total_length_bwd_packets,
         round(value * 100) AS flow_iat_mean,
         round(value * 37) AS flow_iat_std,
         CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS fwd_psh_flags,
         CASE WHEN event_id % 20 = 7 THEN 1 ELSE 0 END AS fwd_urg_flags,
         CASE WHEN event_type = 'error' AND value >= 50 THEN 'DDoS'
              WHEN event_type = 'error' AND value >= 20 THEN 'PortScan'
              WHEN event_type = 'signup' AND value < 5 THEN ' bruteforce '
              ELSE 'BENIGN' END AS label
  FROM events
)"""

SCORED_CTE = FLOWS_CTE + """,
scored AS (
  SELECT *, ((flow_seq * 37) % 1000) / 1000.0 AS score FROM flows
)"""


def with_flows(body: str) -> str:
    return "WITH " + FLOWS_CTE + "\n" + body


def with_scored(extra_ctes: str, body: str) -> str:
    ctes = SCORED_CTE + ("," + extra_ctes if extra_ctes else "")
    return "WITH " + ctes + "\n" + body


def present_sql(sql: str) -> str:
    """Rewrite every ``round(<expr>, 6)`` into the presentation form used by
    the Spark side (``functions.columns.r6``)."""
    out, i = [], 0
    token = "round("
    while True:
        j = sql.find(token, i)
        if j < 0:
            out.append(sql[i:])
            break
        k, depth = j + len(token), 1
        while depth:
            ch = sql[k]
            depth += (ch == "(") - (ch == ")")
            k += 1
        inner = sql[j + len(token):k - 1]
        out.append(sql[i:j])
        if inner.rstrip().endswith(", 6"):
            expr = present_sql(inner.rstrip()[:-3])
            x = f"CAST({expr} AS DOUBLE)"
            out.append(f"(CASE WHEN isnan({x}) OR abs({x}) >= 1e9 THEN {x} + 0.0 "
                       f"ELSE floor({x} * 1000000.0 + 0.5) / 1000000.0 + 0.0 END)")
        else:
            out.append(token + present_sql(inner) + ")")
        i = k
    return "".join(out)
