"""DuckDB statements for scaling, statistics, selection, evaluation and
validation queries."""

from flowsieve.functions.validate import IPV4_RE, IPV6_RE
from flowsieve.plans.oracle_base import FLOWS_CTE

BENIGN = "('BENIGN', 'NORMAL', '0', 'LEGITIMATE')"
FEATS = ["src_port", "dst_port", "flow_duration", "total_fwd_packets", "total_backward_packets",
         "total_length_fwd_packets", "total_length_bwd_packets", "flow_iat_mean", "flow_iat_std",
         "fwd_psh_flags", "fwd_urg_flags", "total_packets", "fwd_bwd_packet_ratio", "total_bytes",
         "avg_packet_size", "flow_rate", "bytes_per_us"]

FEAT_CTE = """
, r1 AS (SELECT *, total_fwd_packets + total_backward_packets AS total_packets,
                total_fwd_packets / (total_backward_packets + 1) AS fwd_bwd_packet_ratio,
                total_length_fwd_packets + total_length_bwd_packets AS total_bytes FROM flows)
, feat AS (SELECT *, total_bytes / (total_packets + 1) AS avg_packet_size,
                  total_packets / (flow_duration + 1) AS flow_rate,
                  total_bytes / (flow_duration + 1) AS bytes_per_us,
                  CASE WHEN upper(trim(label)) IN """ + BENIGN + """ THEN 0 ELSE 1 END AS binary_label
           FROM r1)
, featd AS (SELECT flow_seq, binary_label, """ + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in FEATS) + """ FROM feat)
, long AS (UNPIVOT featd ON """ + ", ".join(FEATS) + """ INTO NAME feature VALUE value)
, pos AS (SELECT * FROM (VALUES """ + ", ".join(f"('{c}', {i})" for i, c in enumerate(FEATS)) + """) t(feature, p))
"""


def _w(body):
    return "WITH " + FLOWS_CTE + FEAT_CTE + body


STANDARDIZE = _w("""
SELECT flow_seq, """ + ",\n       ".join(
    f"round(CASE WHEN stddev_pop({c}) OVER () = 0 THEN 0.0 "
    f"ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END, 6) AS {c}" for c in FEATS) + """
FROM featd""")

INTERACTIONS = _w("""
, vars AS (SELECT feature, var_samp(value) AS v FROM long GROUP BY feature)
, top AS (SELECT feature, row_number() OVER (ORDER BY v DESC NULLS LAST, p) - 1 AS r
          FROM vars JOIN pos USING (feature) QUALIFY r < 10)
, pairs AS (SELECT a.feature AS fa, b.feature AS fb, row_number() OVER (ORDER BY a.r, b.r) AS pr
            FROM top a JOIN top b ON b.r > a.r AND b.r < a.r + 4 QUALIFY pr <= 20)
, ab AS (SELECT la.flow_seq, p.fa, p.fb, la.value AS a, lb.value AS b
         FROM pairs p JOIN long la ON la.feature = p.fa JOIN long lb ON lb.feature = p.fb AND lb.flow_seq = la.flow_seq)
, out AS (SELECT flow_seq, fa || '_x_' || fb AS feature, a * b AS value FROM ab
          UNION ALL SELECT flow_seq, fa || '_div_' || fb, a / (b + 1e-8) FROM ab
          UNION ALL SELECT flow_seq, fa || '_diff_' || fb, a - b FROM ab)
SELECT flow_seq, feature, round(CASE WHEN isfinite(value) THEN value ELSE 0.0 END, 6) AS value FROM out""")

ANOVA = _w("""
, g AS (SELECT feature, binary_label, count(*) AS n_g, avg(value) AS mean_g, var_pop(value) AS var_g
        FROM long WHERE value IS NOT NULL GROUP BY 1, 2)
, g2 AS (SELECT *, sum(n_g) OVER (PARTITION BY feature) AS n,
                sum(n_g * mean_g) OVER (PARTITION BY feature) / sum(n_g) OVER (PARTITION BY feature) AS mean,
                count(*) OVER (PARTITION BY feature) AS k
         FROM g)
, per AS (SELECT feature, sum(n_g * ((mean_g - mean) * (mean_g - mean))) AS ssb, sum(n_g * var_g) AS ssw,
                 any_value(n) AS n, any_value(k) AS k FROM g2 GROUP BY 1)
, f AS (SELECT feature, CASE WHEN ssw = 0 OR k = 1 THEN NULL ELSE (ssb / (k - 1)) / (ssw / (n - k)) END AS f FROM per)
SELECT feature, round(f, 6) AS f_score,
       CAST(row_number() OVER (ORDER BY round(f, 6) DESC NULLS LAST, feature) AS INTEGER) AS rank
FROM f""")

MUTUAL_INFO = _w("""
, lv AS (SELECT * FROM long WHERE value IS NOT NULL AND NOT isnan(value))
, rng AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM lv GROUP BY 1)
, b AS (SELECT lv.feature, binary_label,
               CAST(CASE WHEN (hi - lo) / 10 = 0 THEN 0
                         ELSE least(floor((value - lo) / ((hi - lo) / 10)), 9) END AS INTEGER) AS bin
        FROM lv JOIN rng USING (feature))
, j AS (SELECT feature, bin, binary_label, count(*) AS n_by FROM b GROUP BY 1, 2, 3)
, j2 AS (SELECT *, sum(n_by) OVER (PARTITION BY feature) AS n,
                sum(n_by) OVER (PARTITION BY feature, bin) AS n_b,
                sum(n_by) OVER (PARTITION BY feature, binary_label) AS n_y FROM j)
, mi AS (SELECT feature, sum((n_by / n) * ln(n_by * n / (n_b * n_y))) AS mi FROM j2 GROUP BY 1)
SELECT feature, round(mi, 6) AS mi, CAST(row_number() OVER (ORDER BY round(mi, 6) DESC, feature) AS INTEGER) AS rank
FROM mi""")

def _psi(x: str) -> str:
    z, i = f"({x} + 6.0)", f"(1.0 / (({x} + 6.0) * ({x} + 6.0)))"
    series = f"ln({z}) - 0.5 / {z} - {i} * (1.0/12 - {i} * (1.0/120 - {i} * (1.0/252 - {i} * (1.0/240 - {i} * (1.0/132)))))"
    return f"({series}" + "".join(f" - 1.0 / ({x} + {s}.0)" for s in range(6)) + ")"


def _near(k: int) -> str:
    return ", ".join(f"{{'d': abs({f}(value, {j}) OVER w - value), 'c': {f}(n, {j}) OVER w}}" for f in ("lag", "lead") for j in range(1, k + 1))


# distance to the third nearest row of the class, rows of the column inside it
NEIGHBOR_INFO = _w(f"""
, cells AS (SELECT feature, binary_label AS y, value, count(*) AS n FROM long
            WHERE value IS NOT NULL AND NOT isnan(value) AND abs(value) < 'inf'::DOUBLE GROUP BY 1, 2, 3)
, classed AS (SELECT *, sum(n) OVER (PARTITION BY feature, y) AS n_y FROM cells)
, near AS (SELECT feature, y, value, n, n_y, least(3, n_y - 1) AS k,
                  list_sort(list_filter([{{'d': 0.0::DOUBLE, 'c': n - 1}}, {_near(3)}], lambda s: s.d IS NOT NULL)) AS found
           FROM classed WHERE n_y > 1 WINDOW w AS (PARTITION BY feature, y ORDER BY value))
, points AS (SELECT *, list_min(list_transform(list_filter(range(1, len(found) + 1),
                    lambda i: list_sum(list_transform(found[1:i], lambda s: s.c)) >= k), lambda i: found[i].d)) AS r,
                    row_number() OVER (ORDER BY feature, y, value) AS id FROM near)
, ends AS (SELECT feature, value AS place, 1 AS tag, 0 AS sign, id, n AS held FROM points
           UNION ALL SELECT feature, value - r, CASE WHEN r = 0 THEN 0 ELSE 2 END, -1, id, 0 FROM points
           UNION ALL SELECT feature, value + r, CASE WHEN r = 0 THEN 2 ELSE 0 END, 1, id, 0 FROM points)
, upto AS (SELECT *, sum(held) OVER (PARTITION BY feature ORDER BY place, tag) AS seen FROM ends)
, within AS (SELECT id, CAST(sum(sign * seen) AS DOUBLE) AS m FROM upto WHERE sign <> 0 GROUP BY id)
, terms AS (SELECT feature, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS k, CAST(n_y AS DOUBLE) AS n_y, m
            FROM points JOIN within USING (id))
, mi AS (SELECT feature, sum(n) AS total, sum(n * ({_psi('k')} - {_psi('n_y')} - {_psi('m')})) AS s FROM terms GROUP BY 1)
, scored AS (SELECT feature, greatest(0.0, {_psi('total')} + s / total) AS mi FROM mi)
SELECT feature, round(mi, 6) AS mi, CAST(row_number() OVER (ORDER BY round(mi, 6) DESC, feature) AS INTEGER) AS rank
FROM scored""")

DIRTY = """
, dirty0 AS (SELECT * REPLACE (CASE WHEN flow_seq % 97 = 0 THEN NULL
                                    WHEN flow_seq % 101 = 0 THEN 'inf'::DOUBLE
                                    ELSE flow_duration END AS flow_duration) FROM flows)
, dirty AS (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE flow_seq % 50 = 0)
"""
MISSING_REPORT = "WITH " + FLOWS_CTE + DIRTY + """
, d AS (SELECT count(*) AS rows_after_dedup FROM (SELECT DISTINCT * FROM dirty))
, m AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE flow_duration IS NULL OR isnan(flow_duration))
               + count(*) FILTER (WHERE flow_iat_mean IS NULL OR isnan(flow_iat_mean))
               + count(*) FILTER (WHERE flow_iat_std IS NULL OR isnan(flow_iat_std)) AS missing_cells
        FROM dirty)
SELECT n_rows, 17 AS n_cols, missing_cells, n_rows - rows_after_dedup AS duplicate_rows, rows_after_dedup
FROM m, d"""

EVAL = """
, ev AS (SELECT CASE WHEN upper(trim(label)) IN """ + BENIGN + """ THEN 0 ELSE 1 END AS y,
                CAST((flow_seq * 37) % 1000 AS DOUBLE) / 1000.0 AS prob FROM flows)
, evp AS (SELECT *, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS pred FROM ev)
, cm AS (SELECT count(*) FILTER (WHERE y = 0 AND pred = 0) AS c00, count(*) FILTER (WHERE y = 0 AND pred = 1) AS c01,
                count(*) FILTER (WHERE y = 1 AND pred = 0) AS c10, count(*) FILTER (WHERE y = 1 AND pred = 1) AS c11
         FROM evp)
"""


def _e(body):
    return "WITH " + FLOWS_CTE + EVAL + body


CONFUSION = _e("""
SELECT y AS actual, count(*) FILTER (WHERE pred = 0) AS pred_0, count(*) FILTER (WHERE pred = 1) AS pred_1
FROM evp GROUP BY y""")

REPORT = _e("""
, s AS (SELECT c00, c01, c10, c11,
               coalesce(c00 / nullif(CAST(c00 + c10 AS DOUBLE), 0), 0.0) AS p0,
               coalesce(c00 / nullif(CAST(c00 + c01 AS DOUBLE), 0), 0.0) AS r0,
               coalesce(c11 / nullif(CAST(c11 + c01 AS DOUBLE), 0), 0.0) AS p1,
               coalesce(c11 / nullif(CAST(c11 + c10 AS DOUBLE), 0), 0.0) AS r1,
               c00 + c01 AS s0, c10 + c11 AS s1 FROM cm)
, s2 AS (SELECT *, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0.0) AS f0,
                coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0.0) AS f1, s0 + s1 AS n FROM s)
, rows AS (
  SELECT '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM s2
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM s2
  UNION ALL SELECT 'accuracy', NULL, NULL, (c00 + c11) / CAST(n AS DOUBLE), n FROM s2
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM s2
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f0 * s0 + f1 * s1) / n, n FROM s2)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rows""")

ROC_AUC = _e("""
, per AS (SELECT prob AS s, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y = 0) AS neg
          FROM ev GROUP BY prob)
, cum AS (SELECT *, sum(neg) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS neg_le FROM per)
, u AS (SELECT sum(pos * ((neg_le - neg) + 0.5 * neg)) AS u, CAST(sum(pos) AS BIGINT) AS p,
               CAST(sum(neg) AS BIGINT) AS n FROM cum)
SELECT round(CAST(u AS DOUBLE) / CAST(p * n AS DOUBLE), 6) AS roc_auc, p AS positives, n AS negatives FROM u""")

LOG_LOSS = _e("""
, c AS (SELECT y, prob, least(greatest(prob, 1e-7), 1 - 1e-7) AS p FROM ev)
SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss,
       round(avg(CASE WHEN (CASE WHEN prob > 0.5 THEN 1 ELSE 0 END) = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       count(*) AS n
FROM c""")

INT_RE = "'^[+-]?[0-9]+$'"
VALID_CTE = "WITH " + FLOWS_CTE + """
, raw AS (SELECT flow_seq,
            CASE WHEN flow_seq % 37 = 0 THEN '256.1.1.1' WHEN flow_seq % 41 = 0 THEN '1.2.3'
                 WHEN flow_seq % 43 = 0 THEN '::1' WHEN flow_seq % 47 = 0 THEN ''
                 WHEN flow_seq % 59 = 0 THEN 'fe80::1' WHEN flow_seq % 61 = 0 THEN '1.2.3.4.'
                 WHEN flow_seq % 67 = 0 THEN '010.1.1.1' ELSE src_ip END AS src_ip,
            dst_ip, CAST(src_port AS VARCHAR) AS src_port,
            CASE WHEN flow_seq % 71 = 0 THEN 'abc' WHEN flow_seq % 73 = 0 THEN '80.0'
                 WHEN flow_seq % 79 = 0 THEN NULL ELSE CAST(dst_port AS VARCHAR) END AS dst_port,
            CASE WHEN flow_seq % 97 = 0 THEN NULL ELSE protocol END AS protocol,
            CASE WHEN flow_seq % 83 = 0 THEN 'inf' WHEN flow_seq % 89 = 0 THEN NULL
                 ELSE CAST(CAST(flow_duration AS BIGINT) AS VARCHAR) END AS flow_duration,
            CAST(total_fwd_packets AS VARCHAR) AS total_fwd_packets,
            CAST(total_backward_packets AS VARCHAR) AS total_backward_packets
          , flow_ts, fwd_psh_flags + fwd_urg_flags AS flags
          FROM flows)
, ok AS (SELECT * FROM raw
         WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL AND src_port IS NOT NULL AND dst_port IS NOT NULL
           AND regexp_matches(src_port, """ + INT_RE + """) AND regexp_matches(dst_port, """ + INT_RE + """)
           AND (flow_duration IS NULL OR TRY_CAST(flow_duration AS DOUBLE) IS NOT NULL)
           AND regexp_matches(total_fwd_packets, """ + INT_RE + """)
           AND regexp_matches(total_backward_packets, """ + INT_RE + """)
           AND (regexp_matches(src_ip, '""" + IPV4_RE + """') OR regexp_matches(src_ip, '""" + IPV6_RE + """'))
           AND (regexp_matches(dst_ip, '""" + IPV4_RE + """') OR regexp_matches(dst_ip, '""" + IPV6_RE + """')))
"""

FLOW_VALIDATE = VALID_CTE + """
SELECT flow_seq, src_ip, dst_ip, CAST(src_port AS INTEGER) AS src_port, CAST(dst_port AS INTEGER) AS dst_port,
       coalesce(protocol, 'TCP') AS protocol,
       round(coalesce(TRY_CAST(flow_duration AS DOUBLE), 0.0), 6) AS flow_duration,
       CAST(total_fwd_packets AS BIGINT) AS total_fwd_packets,
       CAST(total_backward_packets AS BIGINT) AS total_backward_packets, 'real_traffic' AS source
FROM ok WHERE flow_seq % 101 <> 0 AND flow_seq % 113 <> 0"""

def _ip_sql(c: str) -> str:
    return f"(regexp_matches({c}, '{IPV4_RE}') OR regexp_matches({c}, '{IPV6_RE}'))"


STREAM_REJECTS = VALID_CTE + f"""
SELECT flow_seq, CASE WHEN src_ip IS NULL THEN 'missing src_ip' WHEN dst_ip IS NULL THEN 'missing dst_ip'
       WHEN src_port IS NULL THEN 'missing src_port' WHEN NOT regexp_matches(src_port, {INT_RE}) THEN 'bad src_port'
       WHEN dst_port IS NULL THEN 'missing dst_port' WHEN NOT regexp_matches(dst_port, {INT_RE}) THEN 'bad dst_port'
       WHEN flow_duration IS NOT NULL AND TRY_CAST(flow_duration AS DOUBLE) IS NULL THEN 'bad flow_duration'
       WHEN NOT {_ip_sql('src_ip')} THEN 'bad address src_ip' WHEN NOT {_ip_sql('dst_ip')} THEN 'bad address dst_ip' END AS reject_reason
FROM raw"""

LIVE_CHAIN = VALID_CTE + """
, scored AS (SELECT *, 1.0::DOUBLE / (1.0 + exp(-(least(CAST(total_fwd_packets AS DOUBLE)
                           / (CAST(total_backward_packets AS DOUBLE) + 1), 6.0) * 0.8 + flags * 0.9 - 2.2))) AS p FROM ok)
, limited AS (SELECT *, count(*) OVER (PARTITION BY src_ip ORDER BY epoch_us(flow_ts)
                              RANGE BETWEEN 172799999999 PRECEDING AND CURRENT ROW) AS window_count
              FROM scored WHERE p > 0.7)
SELECT flow_seq, flow_ts AS timestamp, src_ip, round(p, 6) AS confidence,
       CASE WHEN p >= 0.9 THEN 'CRITICAL' WHEN p >= 0.8 THEN 'HIGH' WHEN p >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
       window_count, window_count <= 3 AS passed
FROM limited"""

WCOLS = ["flow_duration", "total_fwd_packets", "total_backward_packets", "total_length_fwd_packets",
         "total_length_bwd_packets"]
FEATURE_WIDTH = "WITH " + FLOWS_CTE + "\nSELECT flow_seq, " + ", ".join(
    [f"CAST({c} AS DOUBLE) AS p{i}" for i, c in enumerate(WCOLS)]
    + [f"0.0::DOUBLE AS p{i}" for i in range(5, 8)]
    + [f"CAST({c} AS DOUBLE) AS t{i}" for i, c in enumerate(WCOLS[:3])]) + " FROM flows"

ORACLE_STATS = {
    "standardize": STANDARDIZE,
    "interaction_features": INTERACTIONS,
    "anova_f_scores": ANOVA,
    "mutual_info_scores": MUTUAL_INFO,
    "mutual_info_neighbors": NEIGHBOR_INFO,
    "missing_report": MISSING_REPORT,
    "confusion_matrix": CONFUSION,
    "classification_report": REPORT,
    "roc_auc": ROC_AUC,
    "log_loss": LOG_LOSS,
    "flow_validate": FLOW_VALIDATE,
    "stream_live_chain": LIVE_CHAIN,
    "stream_rejects": STREAM_REJECTS,
    "feature_width_fit": FEATURE_WIDTH,
}
