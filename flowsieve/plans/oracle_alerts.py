"""DuckDB statements for the alert, counter and history queries."""

from flowsieve.plans.oracle_base import FLOWS_CTE

SCORED = """
, scored AS (SELECT *, CAST((flow_seq * 37) % 1000 AS DOUBLE) / 1000.0 AS score FROM flows)
, pred AS (SELECT *, src_ip || ':' || CAST(src_port AS VARCHAR) || '->' || dst_ip || ':' || CAST(dst_port AS VARCHAR) AS flow_id,
                  CASE WHEN score > 0.7 THEN 'MALICIOUS' ELSE 'BENIGN' END AS prediction,
                  score AS confidence, (score > 0.7 AND score >= 0.7) AS alert
           FROM scored)
, al AS (SELECT flow_seq,
                'IDS_' || CAST(epoch_us(flow_ts) // 1000000 AS VARCHAR) || '_'
                  || CAST(('0x' || substr(md5(flow_id), 1, 8))::BIGINT % 10000 AS VARCHAR) AS alert_id,
                flow_ts AS timestamp,
                CASE WHEN confidence >= 0.9 THEN 'CRITICAL' WHEN confidence >= 0.8 THEN 'HIGH'
                     WHEN confidence >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
                flow_id, src_ip, dst_ip, src_port, dst_port, protocol, prediction, confidence,
                'Malicious network activity detected with ' || printf('%.2f%%', confidence * 100)
                  || ' confidence' AS description,
                CASE WHEN confidence >= 0.9 THEN 'BLOCK_IMMEDIATELY' WHEN confidence >= 0.8 THEN 'INVESTIGATE_URGENT'
                     WHEN confidence >= 0.7 THEN 'MONITOR_CLOSELY' ELSE 'LOG_AND_REVIEW' END AS recommended_action
         FROM pred WHERE alert)
"""

HISTORY = """
, hourly AS (SELECT date_trunc('hour', flow_ts) AS hour, count(*) AS n,
                    count(*) FILTER (WHERE prediction = 'MALICIOUS') AS m,
                    count(*) FILTER (WHERE alert) AS a
             FROM pred GROUP BY 1)
, cum AS (SELECT hour + INTERVAL 1 HOUR AS timestamp,
                 CAST(sum(n) OVER w AS BIGINT) AS total_flows_processed,
                 CAST(sum(m) OVER w AS BIGINT) AS malicious_flows,
                 CAST(sum(a) OVER w AS BIGINT) AS alerts_generated
          FROM hourly WINDOW w AS (ORDER BY hour ROWS UNBOUNDED PRECEDING))
, hist AS (SELECT *, total_flows_processed - malicious_flows AS benign_flows,
                  100.0::DOUBLE * malicious_flows / greatest(total_flows_processed, 1) AS detection_rate,
                  100.0::DOUBLE * alerts_generated / greatest(total_flows_processed, 1) AS alert_rate
           FROM cum)
"""


def _w(body):
    return "WITH " + FLOWS_CTE + SCORED + body


ORACLE_ALERTS = {
    "score_to_alerts": _w("SELECT * FROM al"),
    "alert_rate_limited": _w("""
, rl AS (SELECT flow_seq, timestamp,
                count(*) OVER (ORDER BY epoch_us(timestamp) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)
                  AS window_count
         FROM al)
SELECT flow_seq, timestamp, window_count, window_count <= 20 AS passed FROM rl"""),
    "severity_counts": _w("SELECT severity, count(*) AS n_alerts FROM al GROUP BY 1"),
    "alerts_per_minute": _w("SELECT date_trunc('minute', timestamp) AS minute, count(*) AS n_alerts FROM al GROUP BY 1"),
    "alert_summary": _w("""
SELECT count(*) AS total_alerts, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_alerts,
       count(*) FILTER (WHERE severity = 'HIGH') AS high_alerts, round(avg(confidence), 6) AS avg_confidence
FROM al"""),
    "alert_filter_top": _w("""
SELECT flow_seq, timestamp, severity, flow_id, confidence, description, recommended_action
FROM al WHERE severity = 'HIGH' AND confidence >= 0.85 ORDER BY timestamp, flow_seq LIMIT 50"""),
    "recent_alerts": _w("""
SELECT flow_seq, timestamp, severity, flow_id, confidence
FROM al ORDER BY timestamp DESC, flow_seq DESC LIMIT 10"""),
    "running_counters": _w("""
, rc AS (SELECT flow_seq,
                count(*) OVER w AS total_flows_processed,
                CAST(sum(CASE WHEN prediction = 'MALICIOUS' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS malicious_flows,
                CAST(sum(CASE WHEN alert THEN 1 ELSE 0 END) OVER w AS BIGINT) AS alerts_generated
         FROM pred WINDOW w AS (ORDER BY flow_ts, flow_seq ROWS UNBOUNDED PRECEDING))
SELECT flow_seq, total_flows_processed, malicious_flows, total_flows_processed - malicious_flows AS benign_flows,
       alerts_generated,
       round(100.0::DOUBLE * malicious_flows / greatest(total_flows_processed, 1), 6) AS detection_rate,
       round(100.0::DOUBLE * alerts_generated / greatest(total_flows_processed, 1), 6) AS alert_rate
FROM rc"""),
    "pipeline_stats": _w("""
, s AS (SELECT count(*) AS total_flows_processed,
               count(*) FILTER (WHERE prediction = 'BENIGN') AS benign_flows,
               count(*) FILTER (WHERE prediction = 'MALICIOUS') AS malicious_flows,
               count(*) FILTER (WHERE alert) AS alerts_generated,
               (max(epoch_us(flow_ts)) - min(epoch_us(flow_ts))) / 1000000.0::DOUBLE AS uptime_seconds
        FROM pred)
SELECT total_flows_processed, benign_flows, malicious_flows, alerts_generated,
       round(uptime_seconds, 6) AS uptime_seconds,
       round(total_flows_processed / greatest(uptime_seconds, 1.0), 6) AS flows_per_second,
       round(100.0::DOUBLE * malicious_flows / greatest(total_flows_processed, 1), 6) AS detection_rate,
       round(100.0::DOUBLE * alerts_generated / greatest(total_flows_processed, 1), 6) AS alert_rate
FROM s"""),
    "history_range_summary": _w(HISTORY + """
SELECT max(total_flows_processed) AS total_flows, max(malicious_flows) AS malicious_flows,
       round(avg(detection_rate), 6) AS avg_detection_rate, max(alerts_generated) AS total_alerts,
       count(*) AS n_snapshots
FROM hist WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-21'"""),
    "detection_rate_histogram": _w(HISTORY + """
, r AS (SELECT min(detection_rate) AS lo, max(detection_rate) AS hi FROM hist)
, b AS (SELECT CAST(CASE WHEN (hi - lo) / 10 = 0 THEN 0
                    ELSE least(floor((detection_rate - lo) / ((hi - lo) / 10)), 9) END AS INTEGER) AS bin, lo, hi
        FROM hist, r)
SELECT bin, round(lo + bin * (hi - lo) / 10, 6) AS bin_start, round(lo + (bin + 1) * (hi - lo) / 10, 6) AS bin_end,
       count(*) AS n
FROM b GROUP BY bin, lo, hi"""),
}

ORACLE_ALERTS["stream_alerts"] = _w("""
, rl AS (SELECT flow_seq, timestamp,
                count(*) OVER (ORDER BY epoch_us(timestamp) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW)
                  AS window_count
         FROM al)
SELECT flow_seq, timestamp, window_count, window_count <= 20 AS passed FROM rl""")
ORACLE_ALERTS["stream_alert_minutes"] = ORACLE_ALERTS["alerts_per_minute"]
ORACLE_ALERTS["stream_counters"] = _w("""
, s AS (SELECT count(*) AS total_flows_processed, count(*) FILTER (WHERE prediction = 'MALICIOUS') AS malicious_flows,
               count(*) FILTER (WHERE alert) AS alerts_generated FROM pred)
SELECT total_flows_processed, malicious_flows, total_flows_processed - malicious_flows AS benign_flows,
       alerts_generated,
       round(100.0::DOUBLE * malicious_flows / greatest(total_flows_processed, 1), 6) AS detection_rate,
       round(100.0::DOUBLE * alerts_generated / greatest(total_flows_processed, 1), 6) AS alert_rate
FROM s""")

ORACLE_ALERTS["alert_rate_limited_by_source"] = _w("""
, rl AS (SELECT flow_seq, src_ip, timestamp,
                count(*) OVER (PARTITION BY src_ip ORDER BY epoch_us(timestamp)
                               RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW) AS window_count
         FROM al)
SELECT flow_seq, src_ip, timestamp, window_count, window_count <= 2 AS passed FROM rl""")
ORACLE_ALERTS["stream_alerts_by_source"] = _w("""
, rl AS (SELECT flow_seq, src_ip, timestamp,
                count(*) OVER (PARTITION BY src_ip ORDER BY epoch_us(timestamp)
                               RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW) AS window_count
         FROM al)
SELECT flow_seq, src_ip, timestamp, window_count, window_count <= 2 AS passed FROM rl""")

ORACLE_ALERTS["stream_alerts_keyed"] = _w("""
, rl AS (SELECT flow_seq, src_ip,
                count(*) OVER (PARTITION BY src_ip ORDER BY epoch_us(timestamp)
                               RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW) AS window_count
         FROM al)
SELECT flow_seq, src_ip, least(window_count, 3) AS window_count, window_count <= 2 AS passed FROM rl""")
ORACLE_ALERTS["stream_counter_snapshot"] = _w("""
, s AS (SELECT count(*) AS total_flows_processed, count(*) FILTER (WHERE prediction = 'MALICIOUS') AS malicious_flows,
               count(*) FILTER (WHERE alert) AS alerts_generated FROM pred)
SELECT total_flows_processed, malicious_flows, total_flows_processed - malicious_flows AS benign_flows,
       alerts_generated, 'real_traffic' AS data_source,
       round(100.0::DOUBLE * malicious_flows / greatest(total_flows_processed, 1), 6) AS detection_rate,
       round(100.0::DOUBLE * alerts_generated / greatest(total_flows_processed, 1), 6) AS alert_rate
FROM s""")
ORACLE_ALERTS["alert_queue_drain"] = _w("""
SELECT flow_seq, timestamp, CAST((row_number() OVER (ORDER BY timestamp NULLS FIRST, flow_seq) - 1) // 1000 + 1 AS INTEGER) AS drain
FROM al""")
