"""Query registry: key -> Spark query, key -> DuckDB oracle statement."""

from __future__ import annotations

from flowsieve.plans import queries_core as qc
from flowsieve.plans import queries_alerts as qa
from flowsieve.plans import queries_csv as qv
from flowsieve.plans import queries_ml as qm
from flowsieve.plans import queries_sources as qs
from flowsieve.plans import queries_stats as qt
from flowsieve.plans import queries_pipelines as qp
from flowsieve.plans import queries_stream as qr
from flowsieve.plans.oracle_base import present_sql
from flowsieve.plans.oracle_alerts import ORACLE_ALERTS
from flowsieve.plans.oracle_core import ORACLE_CORE
from flowsieve.plans.oracle_csv import ORACLE_CSV
from flowsieve.plans.oracle_pipelines import ORACLE_PIPELINES
from flowsieve.plans.oracle_sources import ORACLE_SOURCES
from flowsieve.plans.oracle_stats import ORACLE_STATS


def _utc(fn):
    """Queries read naive (wall-clock) timestamps as UTC; pin the session
    zone so epoch conversions do not depend on the caller's setting."""
    def run(spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def spark_queries() -> dict:
    return {k: _utc(v) for k, v in _queries().items()}


def _queries() -> dict:
    return {
        "flow_profile": qc.q_flow_profile,
        "clean_dataset": qc.q_clean_dataset,
        "flow_ratios": qc.q_flow_ratios,
        "flow_features": qc.q_flow_features,
        "temporal_features": qc.q_temporal_features,
        "rolling_var_std": qc.q_rolling_var_std,
        "rolling_skew_kurt": qc.q_rolling_skew_kurt,
        "rolling_quantiles": qc.q_rolling_quantiles,
        "rolling_mean_std": qc.q_rolling_mean_std,
        "rolling_by_source": qc.q_rolling_by_source,
        "rolling_double": qc.q_rolling_double,
        "statistical_features": qc.q_statistical_features,
        "label_encode": qc.q_label_encode,
        "label_distribution": qc.q_label_distribution,
        "stratified_split": qc.q_stratified_split,
        "conn_parse": qs.q_conn_parse,
        "dns_parse": qs.q_dns_parse,
        "http_parse": qs.q_http_parse,
        "ssl_parse": qs.q_ssl_parse,
        "weird_parse": qs.q_weird_parse,
        "zeek_union": qs.q_zeek_union,
        "conn_header_parse": qs.q_conn_header_parse,
        "zeek_tsv_scan": qs.q_zeek_tsv_scan,
        "score_to_alerts": qa.q_score_to_alerts,
        "alert_rate_limited": qa.q_alert_rate_limited,
        "alert_rate_limited_by_source": qa.q_alert_rate_limited_by_source,
        "severity_counts": qa.q_severity_counts,
        "alerts_per_minute": qa.q_alerts_per_minute,
        "alert_summary": qa.q_alert_summary,
        "alert_filter_top": qa.q_alert_filter_top,
        "recent_alerts": qa.q_recent_alerts,
        "running_counters": qa.q_running_counters,
        "pipeline_stats": qa.q_pipeline_stats,
        "history_range_summary": qa.q_history_range_summary,
        "detection_rate_histogram": qa.q_detection_rate_histogram,
        "standardize": qt.q_standardize,
        "interaction_features": qt.q_interaction_features,
        "anova_f_scores": qt.q_anova_f_scores,
        "mutual_info_scores": qt.q_mutual_info_scores,
        "mutual_info_neighbors": qt.q_mutual_info_neighbors,
        "missing_report": qt.q_missing_report,
        "confusion_matrix": qt.q_confusion_matrix,
        "classification_report": qt.q_classification_report,
        "roc_auc": qt.q_roc_auc,
        "log_loss": qt.q_log_loss,
        "flow_validate": qt.q_flow_validate,
        "feature_width_fit": qt.q_feature_width_fit,
        "csv_sniff": qv.q_csv_sniff,
        "cic_csv_flows": qv.q_cic_csv_flows,
        "rf_importance": qm.q_rf_importance,
        "pca_components": qm.q_pca_components,
        "anomaly_scores": qm.q_anomaly_scores,
        "feature_report": qm.q_feature_report,
        "train_score_eval": qm.q_train_score_eval,
        "loss_curve": qm.q_loss_curve,
        "dense_detector": qm.q_dense_detector,
        "dense_scores": qm.q_dense_scores,
        "dense_history": qm.q_dense_history,
        "reconstruction_scores": qm.q_reconstruction_scores,
        "stream_alerts": qr.q_stream_alerts,
        "stream_alerts_by_source": qr.q_stream_alerts_by_source,
        "stream_counters": qr.q_stream_counters,
        "stream_alert_minutes": qr.q_stream_alert_minutes,
        "stream_alerts_keyed": qr.q_stream_alerts_keyed,
        "stream_rejects": qr.q_stream_rejects,
        "stream_counter_snapshot": qr.q_stream_counter_snapshot,
        "alert_queue_drain": qr.q_alert_queue_drain,
        "adhoc_process": qp.q_adhoc_process,
        "adhoc_features": qp.q_adhoc_features,
        "process_pipeline": qp.q_process_pipeline,
        "engineer_all": qp.q_engineer_all,
        "stream_scoring": qp.q_stream_scoring,
        "stream_live_chain": qp.q_stream_live_chain,
    }


def oracle_statements() -> dict:
    out = {}
    out.update(ORACLE_CORE)
    out.update(ORACLE_SOURCES)
    out.update(ORACLE_ALERTS)
    out.update(ORACLE_STATS)
    out.update(ORACLE_CSV)
    out.update(ORACLE_PIPELINES)
    return {k: present_sql(v) for k, v in out.items()}
