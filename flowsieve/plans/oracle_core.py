"""DuckDB statements for the cleaning, feature and label queries."""

from flowsieve.plans.oracle_base import FLOWS_CTE

BENIGN = "('BENIGN', 'NORMAL', '0', 'LEGITIMATE')"


def _w(body):
    return "WITH " + FLOWS_CTE + body


FLOW_PROFILE = _w("""
, f AS (SELECT DISTINCT * FROM flows)
, g AS (SELECT *, total_fwd_packets + total_backward_packets AS total_packets,
               total_fwd_packets / (total_backward_packets + 1) AS fwd_bwd_packet_ratio,
               total_length_fwd_packets + total_length_bwd_packets AS total_bytes
        FROM f)
, h AS (SELECT *, total_bytes / (total_packets + 1) AS avg_packet_size,
               total_packets / (flow_duration + 1) AS flow_rate,
               total_bytes / (flow_duration + 1) AS bytes_per_us
        FROM g)
SELECT CASE WHEN upper(trim(label)) IN """ + BENIGN + """ THEN 0 ELSE 1 END AS binary_label,
       label AS class_name,
       count(*) AS n_flows,
       round(avg(total_packets), 6) AS avg_total_packets,
       round(avg(fwd_bwd_packet_ratio), 6) AS avg_fwd_bwd_packet_ratio,
       round(avg(total_bytes), 6) AS avg_total_bytes,
       round(avg(avg_packet_size), 6) AS avg_avg_packet_size,
       round(avg(flow_rate), 6) AS avg_flow_rate,
       round(avg(bytes_per_us), 6) AS avg_bytes_per_us,
       round(avg(flow_duration), 6) AS avg_flow_duration
FROM h GROUP BY 1, 2
""")

DIRTY_CTE = """
, dirty0 AS (SELECT * REPLACE (CASE WHEN flow_seq % 97 = 0 THEN NULL
                                    WHEN flow_seq % 101 = 0 THEN 'inf'::DOUBLE
                                    ELSE flow_duration END AS flow_duration) FROM flows)
, dirty AS (SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE flow_seq % 50 = 0)
"""

CLEAN_DATASET = _w(DIRTY_CTE + """
, fin AS (SELECT * REPLACE (CASE WHEN isfinite(flow_duration) THEN flow_duration END AS flow_duration)
          FROM dirty)
, med AS (SELECT median(flow_duration) AS m FROM fin)
SELECT DISTINCT flow_seq, flow_ts, src_ip, dst_ip, src_port, dst_port, protocol,
       round(coalesce(flow_duration, m), 6) AS flow_duration,
       total_fwd_packets, total_backward_packets, total_length_fwd_packets, total_length_bwd_packets,
       round(flow_iat_mean, 6) AS flow_iat_mean, round(flow_iat_std, 6) AS flow_iat_std,
       fwd_psh_flags, fwd_urg_flags, label
FROM fin, med
""")

FLOW_RATIOS = _w("""
SELECT flow_seq,
       total_fwd_packets + total_backward_packets AS total_packets,
       round(total_fwd_packets / (total_backward_packets + 1), 6) AS fwd_bwd_packet_ratio,
       total_length_fwd_packets + total_length_bwd_packets AS total_bytes,
       round((total_length_fwd_packets + total_length_bwd_packets)
             / (total_fwd_packets + total_backward_packets + 1), 6) AS avg_packet_size,
       round((total_fwd_packets + total_backward_packets) / (flow_duration + 1), 6) AS flow_rate,
       round((total_length_fwd_packets + total_length_bwd_packets) / (flow_duration + 1), 6) AS bytes_per_us
FROM flows
""")

FLOW_FEATURES = _w("""
SELECT flow_seq,
       total_fwd_packets + total_backward_packets AS total_packets,
       round(total_fwd_packets / (total_backward_packets + 1), 6) AS fwd_bwd_packet_ratio,
       abs(total_fwd_packets - total_backward_packets) AS packet_asymmetry,
       total_length_fwd_packets + total_length_bwd_packets AS total_bytes,
       round(total_length_fwd_packets / (total_length_bwd_packets + 1), 6) AS fwd_bwd_bytes_ratio,
       abs(total_length_fwd_packets - total_length_bwd_packets) AS bytes_asymmetry,
       round(total_length_fwd_packets / (total_fwd_packets + 1), 6) AS avg_fwd_packet_size,
       round(total_length_bwd_packets / (total_backward_packets + 1), 6) AS avg_bwd_packet_size,
       round((total_length_fwd_packets + total_length_bwd_packets)
             / (total_fwd_packets + total_backward_packets + 1), 6) AS avg_packet_size,
       round(ln(1 + flow_duration), 6) AS flow_duration_log,
       round((total_fwd_packets + total_backward_packets) / (flow_duration / 1000000.0 + 1), 6) AS packets_per_second,
       round((total_length_fwd_packets + total_length_bwd_packets) / (flow_duration / 1000000.0 + 1), 6) AS bytes_per_second,
       round(ln(1 + flow_iat_mean), 6) AS flow_iat_log,
       round(flow_iat_std / (flow_iat_mean + 1), 6) AS flow_iat_cv,
       round(CAST(fwd_psh_flags AS DOUBLE) + CAST(fwd_urg_flags AS DOUBLE), 6) AS total_flags,
       CAST((CASE WHEN fwd_psh_flags > 0 THEN 1 ELSE 0 END) + (CASE WHEN fwd_urg_flags > 0 THEN 1 ELSE 0 END) AS INTEGER) AS flag_diversity,
       CASE WHEN protocol = 'ICMP' THEN 1 ELSE 0 END AS protocol_ICMP,
       CASE WHEN protocol = 'TCP' THEN 1 ELSE 0 END AS protocol_TCP,
       CASE WHEN protocol = 'UDP' THEN 1 ELSE 0 END AS protocol_UDP,
       CASE WHEN src_port <= 1023 THEN 1 ELSE 0 END AS src_port_is_wellknown,
       CASE WHEN src_port > 1023 AND src_port <= 49151 THEN 1 ELSE 0 END AS src_port_is_registered,
       CASE WHEN src_port > 49151 THEN 1 ELSE 0 END AS src_port_is_dynamic,
       CASE WHEN dst_port <= 1023 THEN 1 ELSE 0 END AS dst_port_is_wellknown,
       CASE WHEN dst_port > 1023 AND dst_port <= 49151 THEN 1 ELSE 0 END AS dst_port_is_registered,
       CASE WHEN dst_port > 49151 THEN 1 ELSE 0 END AS dst_port_is_dynamic
FROM flows
""")

TEMPORAL_FEATURES = _w("""
, t AS (SELECT flow_seq, CAST(hour(flow_ts) AS INTEGER) AS hour,
               CAST(isodow(flow_ts) - 1 AS INTEGER) AS day_of_week,
               CAST(month(flow_ts) AS INTEGER) AS month
        FROM flows)
SELECT flow_seq, hour, day_of_week, month,
       CASE WHEN day_of_week >= 5 THEN 1 ELSE 0 END AS is_weekend,
       CASE WHEN hour >= 9 AND hour <= 17 THEN 1 ELSE 0 END AS is_business_hours,
       CASE WHEN hour >= 22 OR hour <= 6 THEN 1 ELSE 0 END AS is_night,
       round(sin(2 * pi() * hour / 24), 6) AS hour_sin,
       round(cos(2 * pi() * hour / 24), 6) AS hour_cos,
       round(sin(2 * pi() * day_of_week / 7), 6) AS day_sin,
       round(cos(2 * pi() * day_of_week / 7), 6) AS day_cos
FROM t
""")

ROLL_COLS = ["flow_duration", "total_fwd_packets", "total_backward_packets", "flow_iat_mean"]


def _frame(n, part):
    p = "PARTITION BY src_ip " if part else ""
    return f"OVER ({p}ORDER BY flow_seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _exact_var(c, w):
    x = f"CAST({c} AS HUGEINT)"
    n = f"count({c}) {w}"
    m2 = f"CAST(CAST({n} AS HUGEINT) * sum({x} * {x}) {w} - sum({x}) {w} * sum({x}) {w} AS DOUBLE)"
    return f"(CASE WHEN {n} > 1 THEN {m2} / CAST({n} * ({n} - 1) AS DOUBLE) END)"


def _var_std(c, part):
    w = _frame(5, part)
    v = _exact_var(c, w)
    return [f"round(coalesce({v}, 0), 6) AS {c}_variance",
            f"round(coalesce(sqrt({v}), 0), 6) AS {c}_std"]


def _skew_kurt(c, part):
    """Exact power-sum moments (values here are below 1e7), bias corrected."""
    w = _frame(10, part)
    x = f"CAST({c} AS DOUBLE)"
    h = f"CAST({c} AS HUGEINT)"
    n = f"CAST(count({c}) {w} AS HUGEINT)"
    nd = f"CAST(count({c}) {w} AS DOUBLE)"
    s1, s2, s3, s4 = (f"sum({h}) {w}", f"sum({h} * {h}) {w}", f"sum({h} * {h} * {h}) {w}",
                      f"sum({h} * {h} * {h} * {h}) {w}")
    m2 = f"CAST({n} * {s2} - {s1} * {s1} AS DOUBLE)"
    m3 = f"CAST({n} * {n} * {s3} - 3 * {n} * {s1} * {s2} + 2 * {s1} * {s1} * {s1} AS DOUBLE)"
    m4 = (f"CAST({n} * {n} * {n} * {s4} - 4 * {n} * {n} * {s1} * {s3} + 6 * {n} * {s1} * {s1} * {s2}"
          f" - 3 * {s1} * {s1} * {s1} * {s1} AS DOUBLE)")
    g1 = f"({m3} / ({m2} * sqrt({m2})))"
    g2 = f"({m4} / ({m2} * {m2}) - 3.0)"
    skew = f"{g1} * sqrt({nd} * ({nd} - 1)) / ({nd} - 2)"
    kurt = f"({nd} - 1) / (({nd} - 2) * ({nd} - 3)) * (({nd} + 1) * {g2} + 6)"
    const = f"max({x}) {w} = min({x}) {w}"
    return [f"round(CASE WHEN {nd} < 3 THEN 0 WHEN {const} THEN 0 ELSE coalesce({skew}, 0) END, 6) AS {c}_skewness",
            f"round(CASE WHEN {nd} < 4 THEN 0 WHEN {const} THEN -3 ELSE coalesce({kurt}, 0) END, 6) AS {c}_kurtosis"]


def _quantiles(c, part):
    w = _frame(10, part)
    x = f"CAST({c} AS DOUBLE)"
    return [f"round(quantile_cont({x}, 0.25) {w}, 6) AS {c}_q25",
            f"round(quantile_cont({x}, 0.75) {w}, 6) AS {c}_q75",
            f"round(quantile_cont({x}, 0.75) {w} - quantile_cont({x}, 0.25) {w}, 6) AS {c}_iqr"]


def _mean_std(c, part):
    out = []
    for k in (5, 10, 20):
        w = _frame(k, part)
        out += [f"round(coalesce(avg(CAST({c} AS DOUBLE)) {w}, 0), 6) AS {c}_rolling_mean_{k}",
                f"round(coalesce(sqrt({_exact_var(c, w)}), 0), 6) AS {c}_rolling_std_{k}"]
    return out


def _rolling_sql(kinds, part=False):
    exprs = []
    for c in ROLL_COLS:
        for k in kinds:
            exprs += {"var_std": _var_std, "skew_kurt": _skew_kurt, "quantiles": _quantiles,
                      "mean_std": _mean_std}[k](c, part)
    cast = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ROLL_COLS)
    return _w(f"\n, m AS (SELECT flow_seq, src_ip, {cast} FROM flows)"
              "\nSELECT flow_seq, src_ip,\n       " + ",\n       ".join(exprs) + "\nFROM m\n")


ROLLING_VAR_STD = _rolling_sql(["var_std"])
ROLLING_SKEW_KURT = _rolling_sql(["skew_kurt"])
ROLLING_QUANTILES = _rolling_sql(["quantiles"])
ROLLING_MEAN_STD = _rolling_sql(["mean_std"])
ROLLING_BY_SOURCE = _rolling_sql(["var_std", "skew_kurt", "quantiles", "mean_std"], part=True)


def _rolling_double_sql():
    exprs = []
    for c in ("iat_part", "fwd_part"):
        exprs += [e.replace(_exact_var(c, _frame(5, False)), f"var_samp({c}) {_frame(5, False)}") for e in _var_std(c, False)]
        exprs += _quantiles(c, False)
        for k in (5, 10, 20):
            w = _frame(k, False)
            exprs += [f"round(coalesce(avg({c}) {w}, 0), 6) AS {c}_rolling_mean_{k}",
                      f"round(coalesce(sqrt(var_samp({c}) {w}), 0), 6) AS {c}_rolling_std_{k}"]
    return _w("\n, m AS (SELECT flow_seq, flow_iat_mean / 7.0::DOUBLE AS iat_part, "
              "total_fwd_packets / 3.0::DOUBLE AS fwd_part FROM flows)\nSELECT flow_seq,\n       "
              + ",\n       ".join(exprs) + "\nFROM m\n")


def _stat_features_sql():
    cols = ["flow_duration", "total_fwd_packets"]
    exprs = []
    for c in cols:
        exprs += _var_std(c, False) + _skew_kurt(c, False) + _quantiles(c, False)
    return _w(DIRTY_CTE + """
, fin AS (SELECT DISTINCT flow_seq, TRY_CAST(flow_duration AS BIGINT) AS flow_duration,
                 total_fwd_packets FROM dirty)
, med AS (SELECT median(flow_duration) AS m FROM fin)
, filled AS (SELECT flow_seq, CAST(coalesce(flow_duration, m) AS BIGINT) AS flow_duration, total_fwd_packets FROM fin, med)
SELECT flow_seq, flow_duration, total_fwd_packets,
       """ + ",\n       ".join(exprs).replace("FROM flows", "") + "\nFROM filled\n")


STATISTICAL_FEATURES = _stat_features_sql()

LABELS_CTE = """
, lab AS (SELECT flow_seq, label AS original_label, upper(trim(label)) AS norm FROM flows)
, cls AS (SELECT norm, CAST(row_number() OVER (ORDER BY norm) - 1 AS INTEGER) AS class_index
          FROM (SELECT DISTINCT norm FROM lab))
, enc AS (SELECT lab.flow_seq, cls.class_index AS label,
                 CASE WHEN lab.norm IN """ + BENIGN + """ THEN 0 ELSE 1 END AS binary_label,
                 lab.original_label, lab.norm
          FROM lab JOIN cls USING (norm))
"""

LABEL_ENCODE = _w(LABELS_CTE.replace(
    "label AS original_label, upper(trim(label)) AS norm FROM flows",
    "label AS original_label, upper(regexp_replace(label, '^\\s+|\\s+$', '', 'g')) AS norm FROM "
    "(SELECT flow_seq, CASE WHEN flow_seq % 11 = 0 THEN label || chr(9) WHEN flow_seq % 13 = 0 "
    "THEN ' ' || label || chr(13) || chr(10) ELSE label END AS label FROM flows)") + """
SELECT flow_seq, label, binary_label, original_label FROM enc
""")

LABEL_DISTRIBUTION = _w(LABELS_CTE + """
SELECT label AS class_index, norm AS class_name, binary_label, count(*) AS n_flows
FROM enc GROUP BY 1, 2, 3
""")

STRATIFIED_SPLIT = _w(LABELS_CTE + """
, counts AS (SELECT binary_label, count(*) AS n FROM enc GROUP BY 1)
, tot AS (SELECT sum(n) AS n_all, CAST(ceil(0.2 * sum(n)) AS BIGINT) AS n_test FROM counts)
, q AS (SELECT c.binary_label, (t.n_test * c.n) // t.n_all AS base,
               (t.n_test * c.n) % t.n_all AS rem, t.n_test FROM counts c, tot t)
, q2 AS (SELECT *, row_number() OVER (ORDER BY rem DESC, CAST(binary_label AS VARCHAR)) AS rr,
                n_test - sum(base) OVER () AS lft FROM q)
, quota AS (SELECT binary_label, base + CASE WHEN rr <= lft THEN 1 ELSE 0 END AS quota FROM q2)
, ranked AS (SELECT flow_seq, binary_label,
                    row_number() OVER (PARTITION BY binary_label
                                       ORDER BY md5('42:' || CAST(flow_seq AS VARCHAR)), flow_seq) AS rn
             FROM enc)
SELECT r.flow_seq, r.binary_label, r.rn <= q.quota AS is_test
FROM ranked r JOIN quota q USING (binary_label)
""")

ORACLE_CORE = {
    "flow_profile": FLOW_PROFILE,
    "clean_dataset": CLEAN_DATASET,
    "flow_ratios": FLOW_RATIOS,
    "flow_features": FLOW_FEATURES,
    "temporal_features": TEMPORAL_FEATURES,
    "rolling_var_std": ROLLING_VAR_STD,
    "rolling_skew_kurt": ROLLING_SKEW_KURT,
    "rolling_quantiles": ROLLING_QUANTILES,
    "rolling_mean_std": ROLLING_MEAN_STD,
    "rolling_by_source": ROLLING_BY_SOURCE,
    "rolling_double": _rolling_double_sql(),
    "statistical_features": STATISTICAL_FEATURES,
    "label_encode": LABEL_ENCODE,
    "label_distribution": LABEL_DISTRIBUTION,
    "stratified_split": STRATIFIED_SPLIT,
}
