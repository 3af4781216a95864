"""Registered queries: scaling, statistics, selection scores, evaluation,
validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.columns import missing, r6
from flowsieve.functions.validate import canonical_flows, fit_width
from flowsieve.operators import evaluate as ev
from flowsieve.operators.features import extract_features
from flowsieve.operators.labels import binary_label, normalized_label
from flowsieve.operators.neighbors import neighbor_mutual_info
from flowsieve.operators.scale import normalize_features
from flowsieve.operators.selection import (anova_f_scores, create_interaction_features, melt,
                                           mutual_info_scores)
from flowsieve.sources.tables import dirty_flows, flow_view, score_column


def _features(spark, sf_dir):
    """Flow view + dataset ratios + binary label; feature list excludes the
    order key and targets."""
    res = extract_features(flow_view(spark, sf_dir), exclude=["flow_seq"])
    df = res.frame.withColumn("binary_label", binary_label(normalized_label(F.col("label"))))
    return df, res.feature_columns


def q_standardize(spark, sf_dir):
    df, feats = _features(spark, sf_dir)
    scaled, _ = normalize_features(df, feats)
    return scaled.select("flow_seq", *[r6(F.col(c)).alias(c) for c in feats])


def q_interaction_features(spark, sf_dir):
    df, feats = _features(spark, sf_dir)
    out, pairs = create_interaction_features(df, feats)
    new = [n for a, b in pairs for n in (f"{a}_x_{b}", f"{a}_div_{b}", f"{a}_diff_{b}")]
    long = melt(out, new, ["flow_seq"])
    return long.select("flow_seq", "feature", r6(F.col("value")).alias("value"))


def q_anova_f_scores(spark, sf_dir):
    df, feats = _features(spark, sf_dir)
    out = anova_f_scores(df, feats, "binary_label")
    return out.select("feature", r6(F.col("f_score")).alias("f_score"), "rank")


def q_mutual_info_scores(spark, sf_dir):
    df, feats = _features(spark, sf_dir)
    out = mutual_info_scores(df, feats, "binary_label", bins=10)
    return out.select("feature", r6(F.col("mi")).alias("mi"), "rank")


def q_mutual_info_neighbors(spark, sf_dir):
    """Nearest-neighbour estimate (k = 3) of every feature with the class."""
    df, feats = _features(spark, sf_dir)
    out = neighbor_mutual_info(df, feats, "binary_label", k=3)
    return out.select("feature", r6(F.col("mi")).alias("mi"), "rank")


def q_missing_report(spark, sf_dir):
    df = dirty_flows(spark, sf_dir)
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    miss = None
    for c in df.columns:
        term = F.count_if(missing(F.col(c), c in floats))
        miss = term if miss is None else miss + term
    stats = df.agg(F.count(F.lit(1)).alias("n_rows"), miss.alias("missing_cells"))
    distinct = df.dropDuplicates().agg(F.count(F.lit(1)).alias("rows_after_dedup"))
    n_rows, missing_cells = stats.collect()[0]
    return distinct.select(F.lit(n_rows).cast("bigint").alias("n_rows"),
                           F.lit(len(df.columns)).alias("n_cols"),
                           F.lit(missing_cells).cast("bigint").alias("missing_cells"),
                           (F.lit(n_rows) - F.col("rows_after_dedup")).cast("bigint").alias("duplicate_rows"),
                           "rows_after_dedup")


def _eval_frame(spark, sf_dir):
    fl = flow_view(spark, sf_dir)
    return fl.select(binary_label(normalized_label(F.col("label"))).alias("y"),
                     score_column(F.col("flow_seq")).alias("prob"))


def q_confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(ev.with_prediction(_eval_frame(spark, sf_dir)))


def q_classification_report(spark, sf_dir):
    rep = ev.classification_report(ev.with_prediction(_eval_frame(spark, sf_dir)))
    return rep.select("label", *[r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


def q_roc_auc(spark, sf_dir):
    out = ev.roc_auc(_eval_frame(spark, sf_dir))
    return out.select(r6(F.col("roc_auc")).alias("roc_auc"), "positives", "negatives")


def q_log_loss(spark, sf_dir):
    out = ev.log_loss_accuracy(_eval_frame(spark, sf_dir))
    return out.select(r6(F.col("log_loss")).alias("log_loss"), r6(F.col("accuracy")).alias("accuracy"), "n")


def raw_records(spark, sf_dir):
    """Flow records as text with malformed addresses, ports and durations."""
    fl = flow_view(spark, sf_dir)
    q = F.col("flow_seq")
    src = (F.when(q % 37 == 0, "256.1.1.1").when(q % 41 == 0, "1.2.3").when(q % 43 == 0, "::1")
           .when(q % 47 == 0, "").when(q % 59 == 0, "fe80::1").when(q % 61 == 0, "1.2.3.4.")
           .when(q % 67 == 0, "010.1.1.1").otherwise(F.col("src_ip")))
    dport = (F.when(q % 71 == 0, "abc").when(q % 73 == 0, "80.0").when(q % 79 == 0, F.lit(None))
             .otherwise(F.col("dst_port").cast("string")))
    dur = (F.when(q % 83 == 0, "inf").when(q % 89 == 0, F.lit(None))
           .otherwise(F.col("flow_duration").cast("bigint").cast("string")))
    proto = F.when(q % 97 == 0, F.lit(None)).otherwise(F.col("protocol"))
    return fl.select("flow_seq", "flow_ts", src.alias("src_ip"), "dst_ip",
                     F.col("src_port").cast("string").alias("src_port"), dport.alias("dst_port"),
                     proto.alias("protocol"), dur.alias("flow_duration"),
                     F.col("total_fwd_packets").cast("string").alias("total_fwd_packets"),
                     F.col("total_backward_packets").cast("string").alias("total_backward_packets"))


def q_flow_validate(spark, sf_dir):
    q = F.col("flow_seq")
    raw = raw_records(spark, sf_dir).withColumn("flow_ts", F.when(q % 101 == 0, "garbage").otherwise(
        F.col("flow_ts").cast("string"))).withColumn("dst_port", F.when(q % 113 == 0, "4294967296").otherwise(F.col("dst_port")))
    out = canonical_flows(raw, keep=["flow_seq"])
    return out.select("flow_seq", "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
                      r6(F.col("flow_duration")).alias("flow_duration"), "total_fwd_packets",
                      "total_backward_packets", "source")


WIDTH_COLS = ["flow_duration", "total_fwd_packets", "total_backward_packets",
              "total_length_fwd_packets", "total_length_bwd_packets"]


def q_feature_width_fit(spark, sf_dir):
    fl = flow_view(spark, sf_dir)
    arr = F.array(*[F.col(c).cast("double") for c in WIDTH_COLS])
    padded, cut = fit_width(arr, 8), fit_width(arr, 3)
    return fl.select("flow_seq", *[padded[i].alias(f"p{i}") for i in range(8)],
                     *[cut[i].alias(f"t{i}") for i in range(3)])

