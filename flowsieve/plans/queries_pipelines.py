"""Registered pipeline queries: ad-hoc processing with export, the training
pipeline from a dataset file, full feature engineering, streaming scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.columns import r6
from flowsieve.operators import alerts as al
from flowsieve.operators import ml
from flowsieve.functions.validate import canonical_flows
from flowsieve.operators.features import extract_features, extract_flow_features
from flowsieve.operators.labels import encode_labels
from flowsieve.operators.selection import melt
from flowsieve.operators.stats import exact_medians
from flowsieve.plans import pipelines as pl
from flowsieve.plans.queries_csv import write_dataset_csv
from flowsieve.plans.queries_stats import raw_records
from flowsieve.plans.queries_stream import FILES_PER_RANGE, write_stream_input
from flowsieve.session import work_dir
from flowsieve.sources.csv_flows import load_flow_csv
from flowsieve.sources.tables import flow_view
from flowsieve.streaming import sinks
from flowsieve.streaming.alerts import clean_stream, rate_limit_query
from flowsieve.streaming.sources import flow_stream


def q_adhoc_process(spark, sf_dir):
    """Clean, dataset features, labels, scaling, top-5 by ANOVA F, exported
    to parquet and read back; long format (flow_seq, binary_label, feature,
    value)."""
    fl = flow_view(spark, sf_dir).drop("protocol", "flow_ts", "src_ip", "dst_ip")
    res = pl.adhoc_process(fl, features=False)
    path = work_dir(spark, "adhoc-export")
    res.frame.write.mode("overwrite").parquet(path)
    back = spark.read.parquet(path)
    long = melt(back, res.features, ["flow_seq", "binary_label"])
    return long.select("flow_seq", "binary_label", "feature", r6(F.col("value")).alias("value"))


def q_adhoc_features(spark, sf_dir):
    """The same over all columns, with dataset and flow features on."""
    res = pl.adhoc_process(flow_view(spark, sf_dir))
    long = melt(res.frame, res.features, ["flow_seq", "binary_label"])
    return long.select("flow_seq", "binary_label", "feature", r6(F.col("value")).alias("value"))


def q_process_pipeline(spark, sf_dir):
    """Dataset CSV -> clean -> features -> labels -> split -> scaler fitted on
    the training part; the scaled rows of both parts."""
    df = load_flow_csv(spark, write_dataset_csv(spark, sf_dir))
    res = pl.process_pipeline(df, "flow_seq", 0.2, 42, fit_scope="train")
    scaled = ["flow_duration", "total_fwd_packets", "fwd_bwd_packet_ratio", "total_bytes"]
    return res.frame.select(F.col("flow_seq").cast("long").alias("flow_seq"), "binary_label", "is_test",
                            *[r6(F.col(c)).alias(c) for c in scaled])


def q_engineer_all(spark, sf_dir):
    fl = flow_view(spark, sf_dir).drop("flow_ts", "src_ip", "dst_ip")
    res = pl.engineer_all_features(fl, "flow_seq")
    return res.frame.select("flow_seq", *res.features)


def q_stream_scoring(spark, sf_dir):
    """Train a detector on the first time range, then score the whole
    stream with it: frozen medians, dataset features, model, alerts."""
    root, schema = write_stream_input(spark, sf_dir)
    first = spark.read.parquet(f"{root}/part0")
    res = extract_features(first, exclude=["flow_seq", "score"])
    enc, _ = encode_labels(res.frame)
    feats = [c for c in res.feature_columns if c != "score"]
    path = work_dir(spark, "stream-model")
    ml.save_model(ml.train_detector(enc, feats, "binary_label", kind="logreg"), path)
    model = ml.load_model(path)
    medians = exact_medians(first, ["flow_duration"]).medians      # frozen at training time
    stream = flow_stream(spark, "parquet", f"{root}/part*/*.parquet", schema=schema,
                         max_files_per_trigger=FILES_PER_RANGE)

    def score(flows):
        scored = ml.predict_batch(model, extract_features(flows, exclude=["flow_seq", "score"]).frame, threshold=0.7)
        return al.score_flows(scored, "prob", 0.7).select(
            "flow_seq", "flow_ts", "flow_id", "prediction", "confidence", "alert", "_day")

    out, ck = work_dir(spark, "stream-scored"), work_dir(spark, "stream-scored-ckpt")
    sinks.append_new_rows(clean_stream(stream, medians), out, ck, ["flow_seq"], "flow_ts", score).awaitTermination()
    return spark.read.parquet(out).drop("batch_id", "_day")


def linear_score(ratio, flags):
    """A fixed linear scorer: the logistic of a weighted packet ratio and flag total."""
    return 1.0 / (1.0 + F.exp(-(F.least(ratio, F.lit(6.0)) * 0.8 + flags * 0.9 - 2.2)))


def q_stream_live_chain(spark, sf_dir):
    """The live chain over a stream with bad and repeated records: validate,
    fill, drop repeats, dataset and flow features, score with a fixed scorer,
    alerts, rate limit per source. One row per alert."""
    raw = raw_records(spark, sf_dir).withColumn("fwd_psh_flags", (F.col("flow_seq") % 10 == 0).cast("int")) \
        .withColumn("fwd_urg_flags", (F.col("flow_seq") % 20 == 7).cast("int"))
    repeated = raw.unionByName(raw.where("flow_seq % 7 = 0"))
    root, schema = write_stream_input(spark, sf_dir, repeated)
    stream = flow_stream(spark, "parquet", f"{root}/part*/*.parquet", schema=schema,
                         max_files_per_trigger=FILES_PER_RANGE)
    valid = canonical_flows(stream, keep=["flow_seq", "fwd_psh_flags", "fwd_urg_flags"])

    def score(flows):
        base = extract_features(flows, exclude=["flow_seq"]).frame
        flow = extract_flow_features(base, protocols=[], flags=["fwd_psh_flags", "fwd_urg_flags"], ports=[]).frame
        p = linear_score(F.coalesce("fwd_bwd_packet_ratio", F.lit(0.0)), F.col("total_flags"))
        return al.score_flows(flow.withColumn("p", p), "p", 0.7)

    scored, ck = work_dir(spark, "live-scored"), work_dir(spark, "live-ckpt")
    sinks.append_new_rows(clean_stream(valid, {"flow_duration": 0.0}), scored, ck, ["flow_seq"], "flow_ts",
                          score).awaitTermination()
    alerts = al.make_alerts(spark.readStream.schema(spark.read.parquet(scored).schema).parquet(scored))
    attempts, out, ck = (work_dir(spark, f"live-{x}") for x in ("attempts", "out", "limit-ckpt"))
    query = rate_limit_query(alerts, attempts, out, ck, cap=3, window_seconds=2 * 86400, key_cols=["src_ip"])
    query.awaitTermination()
    return sinks.latest_snapshot(spark, out, ["flow_seq"]).select(
        "flow_seq", "timestamp", "src_ip", r6(F.col("confidence")).alias("confidence"), "severity", "window_count", "passed")
