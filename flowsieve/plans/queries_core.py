"""Registered queries: cleaning, features, labels (Spark side).

Every query takes ``(spark, sf_dir)``, reads the driver tables through the
flow view and returns a lazy DataFrame whose column names match the SQL
statement of the same key in ``oracle_core``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.columns import r6
from flowsieve.operators.clean import clean_dataset
from flowsieve.operators.features import (extract_features, extract_flow_features,
                                          extract_temporal_features)
from flowsieve.operators.labels import encode_labels, stratified_split
from flowsieve.operators.rolling import extract_statistical_features, rolling_features
from flowsieve.sources.tables import dirty_flows, flow_view

ROLL_COLS = ["flow_duration", "total_fwd_packets", "total_backward_packets", "flow_iat_mean"]


def _round_all(df, keep=()):
    """Round every floating column to 6 places (result presentation)."""
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() in ("double", "float") and f.name not in keep:
            out.append(r6(F.col(f"`{f.name}`")).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def q_flow_profile(spark, sf_dir):
    """Flagship: clean -> ratios -> labels -> mean features per class."""
    flows = clean_dataset(flow_view(spark, sf_dir))
    feats = extract_features(flows, exclude=["flow_seq"]).frame
    enc, _ = encode_labels(feats)
    return (enc.groupBy("binary_label", F.col("original_label").alias("class_name"))
            .agg(F.count(F.lit(1)).alias("n_flows"),
                 r6(F.avg("total_packets")).alias("avg_total_packets"),
                 r6(F.avg("fwd_bwd_packet_ratio")).alias("avg_fwd_bwd_packet_ratio"),
                 r6(F.avg("total_bytes")).alias("avg_total_bytes"),
                 r6(F.avg("avg_packet_size")).alias("avg_avg_packet_size"),
                 r6(F.avg("flow_rate")).alias("avg_flow_rate"),
                 r6(F.avg("bytes_per_us")).alias("avg_bytes_per_us"),
                 r6(F.avg("flow_duration")).alias("avg_flow_duration")))


def q_clean_dataset(spark, sf_dir):
    return _round_all(clean_dataset(dirty_flows(spark, sf_dir)))


def q_flow_ratios(spark, sf_dir):
    res = extract_features(flow_view(spark, sf_dir), exclude=["flow_seq"])
    new = ["total_packets", "fwd_bwd_packet_ratio", "total_bytes", "avg_packet_size",
           "flow_rate", "bytes_per_us"]
    return _round_all(res.frame.select("flow_seq", *new))


def q_flow_features(spark, sf_dir):
    res = extract_flow_features(flow_view(spark, sf_dir))
    return _round_all(res.frame.select("flow_seq", *res.feature_columns))


def q_temporal_features(spark, sf_dir):
    fl = flow_view(spark, sf_dir)
    res = extract_temporal_features(fl, "flow_ts", "flow_seq", rolling_cols=[])
    return _round_all(res.frame.select("flow_seq", *res.feature_columns))


def _integral_measures(fl):
    """Duration and IAT mean are whole numbers by construction; carry them as
    bigint so window variances use exact integer power sums."""
    return fl.select("flow_seq", "src_ip",
                     *[F.col(c).cast("bigint").alias(c) for c in ROLL_COLS])


def _rolling(spark, sf_dir, kinds, partition_cols=None):
    fl = _integral_measures(flow_view(spark, sf_dir))
    out = rolling_features(fl, ROLL_COLS, "flow_seq", kinds=kinds, partition_cols=partition_cols)
    return _round_all(out.drop(*ROLL_COLS))


def q_rolling_var_std(spark, sf_dir):
    return _rolling(spark, sf_dir, ("var_std",))


def q_rolling_skew_kurt(spark, sf_dir):
    return _rolling(spark, sf_dir, ("skew_kurt",))


def q_rolling_quantiles(spark, sf_dir):
    return _rolling(spark, sf_dir, ("quantiles",))


def q_rolling_mean_std(spark, sf_dir):
    return _rolling(spark, sf_dir, ("mean_std",))


def q_rolling_double(spark, sf_dir):
    """Windows over fractional doubles."""
    fl = flow_view(spark, sf_dir).select("flow_seq", (F.col("flow_iat_mean") / 7.0).alias("iat_part"),
                                         (F.col("total_fwd_packets") / 3.0).alias("fwd_part"))
    out = rolling_features(fl, ["iat_part", "fwd_part"], "flow_seq", kinds=("var_std", "quantiles", "mean_std"))
    return _round_all(out.drop("iat_part", "fwd_part"))


def q_rolling_by_source(spark, sf_dir):
    return _rolling(spark, sf_dir, ("var_std", "skew_kurt", "quantiles", "mean_std"),
                    partition_cols=["src_ip"])


def q_statistical_features(spark, sf_dir):
    """C3 on dirty input: Inf to missing, median fill, windows, zero fill."""
    fl = (dirty_flows(spark, sf_dir)
          .select("flow_seq", F.col("flow_duration").try_cast("bigint").alias("flow_duration"),
                  "total_fwd_packets").dropDuplicates())
    out = extract_statistical_features(fl, ["flow_duration", "total_fwd_packets"], "flow_seq")
    return _round_all(out)


def spaced_labels(spark, sf_dir):
    """Labels as files bring them: with tabs, carriage returns and blanks around."""
    q, label = F.col("flow_seq"), F.col("label")
    return flow_view(spark, sf_dir).select("flow_seq", F.when(q % 11 == 0, F.concat(label, F.lit("\t")))
                                           .when(q % 13 == 0, F.concat(F.lit(" "), label, F.lit("\r\n")))
                                           .otherwise(label).alias("label"))


def q_label_encode(spark, sf_dir):
    return encode_labels(spaced_labels(spark, sf_dir))[0]


def q_label_distribution(spark, sf_dir):
    enc, _ = encode_labels(flow_view(spark, sf_dir).select("flow_seq", "label"))
    return (enc.groupBy(F.col("label").alias("class_index"),
                        F.upper(F.trim("original_label")).alias("class_name"), "binary_label")
            .agg(F.count(F.lit(1)).alias("n_flows")))


def q_stratified_split(spark, sf_dir):
    enc, _ = encode_labels(flow_view(spark, sf_dir).select("flow_seq", "label"))
    return stratified_split(enc, "binary_label", "flow_seq", 0.2, 42).select(
        "flow_seq", "binary_label", "is_test")
