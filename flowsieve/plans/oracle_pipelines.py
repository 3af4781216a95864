"""DuckDB statements for the pipeline queries with exact results."""

import re

from flowsieve.plans.oracle_base import FLOWS_CTE
from flowsieve.plans.oracle_core import FLOW_FEATURES

BENIGN = "('BENIGN', 'NORMAL', '0', 'LEGITIMATE')"
F11 = ["src_port", "dst_port", "flow_duration", "total_fwd_packets", "total_backward_packets",
       "total_length_fwd_packets", "total_length_bwd_packets", "flow_iat_mean", "flow_iat_std",
       "fwd_psh_flags", "fwd_urg_flags"]

# what the flow features add, each a numeric column of the ad-hoc table
FLOW_LINES = FLOW_FEATURES.split("SELECT flow_seq,")[-1].split("FROM flows")[0]
ADDED = re.findall(r"AS (\w+),?\s*$", FLOW_LINES, re.M)


def _unrounded(sql: str) -> str:
    """round(<expr>, 6) as (<expr>)."""
    while (at := sql.find("round(")) >= 0:
        depth, end = 1, at + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[:at] + "(" + sql[at + len("round("):end - 1].rstrip().removesuffix(", 6") + ")" + sql[end:]
    return sql


FEATURES_CTE = """
, feat AS (SELECT flow_seq, label, """ + ", ".join(F11) + """,
       (total_fwd_packets + total_backward_packets) / (flow_duration + 1) AS flow_rate,
       (total_length_fwd_packets + total_length_bwd_packets) / (flow_duration + 1) AS bytes_per_us,
       """ + _unrounded(FLOW_LINES) + """ FROM flows)"""


def _adhoc(columns: list[str], table: str, ctes: str = "") -> str:
    return "WITH " + FLOWS_CTE + ctes + """
, lab AS (SELECT *, CASE WHEN upper(trim(label)) IN """ + BENIGN + """ THEN 0 ELSE 1 END AS binary_label FROM """ + table + """)
, scaled AS (SELECT flow_seq, binary_label, """ + ", ".join(
    f"CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0.0 ELSE (CAST({c} AS DOUBLE) - avg({c}) OVER ()) "
    f"/ stddev_pop({c}) OVER () END AS {c}" for c in columns) + """ FROM lab)
, long AS (UNPIVOT scaled ON """ + ", ".join(columns) + """ INTO NAME feature VALUE value)
, g AS (SELECT feature, binary_label, count(*) AS n_g, avg(value) AS mean_g, var_pop(value) AS var_g
        FROM long WHERE value IS NOT NULL GROUP BY 1, 2)
, g2 AS (SELECT *, sum(n_g) OVER (PARTITION BY feature) AS n,
                sum(n_g * mean_g) OVER (PARTITION BY feature) / sum(n_g) OVER (PARTITION BY feature) AS mean,
                count(*) OVER (PARTITION BY feature) AS k FROM g)
, per AS (SELECT feature, sum(n_g * ((mean_g - mean) * (mean_g - mean))) AS ssb, sum(n_g * var_g) AS ssw,
                 any_value(n) AS n, any_value(k) AS k FROM g2 GROUP BY 1)
, f AS (SELECT feature, CASE WHEN ssw = 0 OR k = 1 THEN NULL ELSE (ssb / (k - 1)) / (ssw / (n - k)) END AS f FROM per)
, top AS (SELECT feature FROM f QUALIFY row_number() OVER (ORDER BY round(f, 6) DESC NULLS LAST, feature) <= 5)
SELECT flow_seq, binary_label, feature, round(value, 6) AS value FROM long JOIN top USING (feature)"""


ADHOC = _adhoc(F11, "flows")
ADHOC_FEATURES = _adhoc([*F11, "flow_rate", "bytes_per_us", *ADDED], "feat", FEATURES_CTE)

PROCESS_PIPELINE = "WITH " + FLOWS_CTE + """
, enc AS (SELECT flow_seq, CASE WHEN upper(trim(label)) IN """ + BENIGN + """ THEN 0 ELSE 1 END AS binary_label FROM flows)
, counts AS (SELECT binary_label, count(*) AS n FROM enc GROUP BY 1)
, tot AS (SELECT sum(n) AS n_all, CAST(ceil(0.2 * sum(n)) AS BIGINT) AS n_test FROM counts)
, q AS (SELECT c.binary_label, (t.n_test * c.n) // t.n_all AS base,
               (t.n_test * c.n) % t.n_all AS rem, t.n_test FROM counts c, tot t)
, q2 AS (SELECT *, row_number() OVER (ORDER BY rem DESC, CAST(binary_label AS VARCHAR)) AS rr,
                n_test - sum(base) OVER () AS lft FROM q)
, quota AS (SELECT binary_label, base + CASE WHEN rr <= lft THEN 1 ELSE 0 END AS quota FROM q2)
, ranked AS (SELECT flow_seq, binary_label,
                    row_number() OVER (PARTITION BY binary_label
                                       ORDER BY md5('42:' || CAST(CAST(flow_seq AS DOUBLE) AS VARCHAR)),
                                                CAST(flow_seq AS DOUBLE)) AS rn
             FROM enc)
, split AS (SELECT r.flow_seq, r.binary_label, r.rn <= q.quota AS is_test FROM ranked r JOIN quota q USING (binary_label))
, x AS (SELECT split.*, CAST(flow_duration AS DOUBLE) AS a, CAST(total_fwd_packets AS DOUBLE) AS b,
               CAST(total_fwd_packets AS DOUBLE) / (total_backward_packets + 1) AS c,
               CAST(total_length_fwd_packets + total_length_bwd_packets AS DOUBLE) AS d
        FROM split JOIN flows USING (flow_seq))
, fit AS (SELECT avg(a) AS am, stddev_pop(a) AS asd, avg(b) AS bm, stddev_pop(b) AS bsd, avg(c) AS cm, stddev_pop(c) AS csd,
                 avg(d) AS dm, stddev_pop(d) AS dsd FROM x WHERE NOT is_test)
SELECT flow_seq, binary_label, is_test, round((a - am) / asd, 6) AS flow_duration, round((b - bm) / bsd, 6) AS total_fwd_packets,
       round((c - cm) / csd, 6) AS fwd_bwd_packet_ratio, round((d - dm) / dsd, 6) AS total_bytes
FROM x, fit"""

ORACLE_PIPELINES = {"adhoc_process": ADHOC, "adhoc_features": ADHOC_FEATURES, "process_pipeline": PROCESS_PIPELINE}
