"""Registered queries on Spark ML: forest importance, PCA, anomaly scores,
detector training/scoring/evaluation with save and load, feature report.

Model fits are not SQL; these keys have no oracle statement (rows-only).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.functions.columns import r6
from flowsieve.operators import evaluate as ev
from flowsieve.operators import ml
from flowsieve.operators.alerts import score_flows, severity
from flowsieve.operators.dense_net import TrainConfig
from flowsieve.operators.detector import FlowDetector, train_flow_detector, train_reconstruction
from flowsieve.operators.labels import binary_label, normalized_label, stratified_split
from flowsieve.plans.queries_stats import _features
from flowsieve.session import work_dir, written
from flowsieve.sources.tables import flow_view
from flowsieve.operators.scale import normalize_features


def q_rf_importance(spark, sf_dir):
    df, feats = _features(spark, sf_dir)
    out = ml.rf_feature_importance(df, feats, "binary_label", num_trees=100)
    return out.select("feature", r6(F.col("rf_importance")).alias("rf_importance"), "rank")


def q_pca_components(spark, sf_dir):
    """PCA of the standardised features (as the training path feeds it)."""
    df, feats = _features(spark, sf_dir)
    scaled, _ = normalize_features(df, feats)
    out = ml.pca_explained(scaled, feats, 0.95)
    return out.select("component", r6(F.col("explained_variance")).alias("explained_variance"),
                      r6(F.col("cumulative")).alias("cumulative"), "selected")


def q_anomaly_scores(spark, sf_dir):
    df, feats = _features(spark, sf_dir)
    out = ml.pca_anomaly_scores(df, feats, k=3)
    return out.select("flow_seq", r6(F.col("anomaly_score")).alias("anomaly_score"))


def q_feature_report(spark, sf_dir):
    df, feats = _features(spark, sf_dir)
    out = ml.feature_report(df, feats, "binary_label", num_trees=100)
    return out.select("feature", r6(F.col("rf_importance")).alias("rf_importance"),
                      r6(F.col("f_score")).alias("f_score"), "rf_rank", "f_rank",
                      "top_by_importance", "top_by_f_score")


def q_train_score_eval(spark, sf_dir, kind: str = "mlp", max_iter: int = 100):
    """Split -> train (scaler fitted on the training part) -> save -> load ->
    score the test part -> metrics rows (metric, value)."""
    df, feats = _features(spark, sf_dir)
    split = stratified_split(df, "binary_label", "flow_seq", 0.2, 42)
    train = split.where(~F.col("is_test"))
    test = split.where(F.col("is_test"))
    model = ml.train_detector(train, feats, "binary_label", kind=kind, max_iter=max_iter)
    path = work_dir(spark, "detector-model")
    ml.save_model(model, path)
    loaded = ml.load_model(path)
    scored = ml.predict_batch(loaded, test.select("flow_seq", "binary_label", *feats))
    return _metrics(written(scored.select("prob", F.col("binary_label").alias("y")), "detector-scores"))


def _metrics(scored):
    """(metric, value) of rows with y and prob."""
    ll = ev.log_loss_accuracy(scored, "y", "prob")
    auc = ev.roc_auc(scored, "y", "prob")
    a = ll.select(F.explode(F.array(
        F.struct(F.lit("log_loss").alias("metric"), r6(F.col("log_loss")).alias("value")),
        F.struct(F.lit("accuracy").alias("metric"), r6(F.col("accuracy")).alias("value")),
        F.struct(F.lit("n_test").alias("metric"), F.col("n").cast("double").alias("value")))).alias("m")
    ).select("m.*")
    b = auc.select(F.lit("roc_auc").alias("metric"), r6(F.col("roc_auc")).alias("value"))
    return a.unionByName(b)


def q_loss_curve(spark, sf_dir, max_iter: int = 100):
    """Objective value per training iteration of the perceptron detector."""
    df, feats = _features(spark, sf_dir)
    model = ml.train_detector(df, feats, "binary_label", kind="mlp", max_iter=max_iter)
    hist = ml.training_history(model)
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(hist)],
                                 "iteration int, loss double")


def _raw_split(spark, sf_dir):
    """Raw flows with a stratified test mark; what is derived comes later."""
    flows = flow_view(spark, sf_dir).drop("score")
    marked = flows.withColumn("_y", binary_label(normalized_label(F.col("label"))))
    split = written(stratified_split(marked, "_y", "flow_seq", 0.2, 42).drop("_y"), "detector-split")
    return split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test")


DETECTOR_TRAINING = TrainConfig(epochs=20, steps=16, learning_rate=6e-3)


def q_dense_detector(spark, sf_dir):
    """The dense detector on raw flows: train, save, load, score the test part
    as it came, metrics rows (metric, value)."""
    train, test = _raw_split(spark, sf_dir)
    path = work_dir(spark, "dense-detector")
    train_flow_detector(train, cfg=DETECTOR_TRAINING).save(spark, path)
    scored = FlowDetector.load(spark, path).score(test)
    return _metrics(written(scored.select("prob", binary_label(normalized_label(F.col("label"))).alias("y")), "detector-scores"))


def q_dense_scores(spark, sf_dir):
    """Probability, alert and severity of every raw flow by a saved detector."""
    train, _ = _raw_split(spark, sf_dir)
    path = work_dir(spark, "dense-detector")
    train_flow_detector(train, cfg=DETECTOR_TRAINING).save(spark, path)
    scored = FlowDetector.load(spark, path).score(flow_view(spark, sf_dir).drop("score"))
    out = score_flows(scored, "prob", 0.7)
    return out.select("flow_seq", "prob", "prediction", "alert", severity(F.col("confidence")).alias("severity"))


def q_dense_history(spark, sf_dir):
    """Loss, validation loss and learning rate of each epoch."""
    train, _ = _raw_split(spark, sf_dir)
    return train_flow_detector(train, cfg=DETECTOR_TRAINING).history(spark)


def q_reconstruction_scores(spark, sf_dir):
    """Reconstruction error of every flow by an encoder and decoder trained on
    all of them without labels."""
    flows = flow_view(spark, sf_dir).drop("score")
    detector = train_reconstruction(flows, code=4, wide=(32, 16), dropout=0.0, cfg=DETECTOR_TRAINING)
    return detector.score(flows, "reconstruction_error").select("flow_seq", "reconstruction_error")
