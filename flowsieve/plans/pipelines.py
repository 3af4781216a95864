"""Composite pipelines built from the operators (all lazy DataFrames; the
only actions are the small fit steps: medians, scaler statistics, class
counts, distinct protocol values, variance ranking)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.columns import finite_or_null, float_columns, integral_columns, numeric_columns
from flowsieve.operators.clean import clean_dataset
from flowsieve.operators.features import (extract_features, extract_flow_features, flag_columns,
                                          port_columns)
from flowsieve.operators.labels import encode_labels, stratified_split
from flowsieve.operators.ml import rf_feature_importance
from flowsieve.operators.neighbors import neighbor_mutual_info
from flowsieve.operators.ordering import IDX, dense_index_with_total
from flowsieve.operators.rolling import integral_magnitudes
from flowsieve.operators.sliding import sliding_statistics
from flowsieve.operators.stats import exact_medians
from flowsieve.operators.scale import normalize_features
from flowsieve.operators.selection import anova_f_scores, create_interaction_features, mutual_info_scores
from flowsieve.schema import TARGET_COLUMNS
from flowsieve.session import written


@dataclass
class Prepared:
    frame: DataFrame
    features: list
    info: dict = field(default_factory=dict)


def engineer_all_features(df: DataFrame, order_col: str, target: str = "label",
                          bucket_rows: int | None = None) -> Prepared:
    """Statistical windows on the first ten numeric columns, flow features,
    rolling means/stds of the first five, then interaction terms.

    One dense index and one window pass serve both window families (the
    rolling step reads the median-filled columns, as in sequence); the flag
    and port rules look at the original columns only.
    """
    numeric = numeric_columns(df, exclude=[target, *TARGET_COLUMNS, order_col])
    stat_cols, roll_cols = numeric[:10], numeric[:5]
    floats = set(float_columns(df))
    cleaned = df.select(*[finite_or_null(F.col(f"`{c}`")).alias(c) if (c in stat_cols and c in floats)
                          else F.col(f"`{c}`") for c in df.columns])
    indexed, total = dense_index_with_total(cleaned, [order_col])
    fit = exact_medians(indexed, stat_cols, only_with_missing=True)
    fills = {c: m for c, m in fit.medians.items() if m is not None and fit.missing[c] > 0}
    if fills:
        indexed = indexed.fillna(fills)
    integral = [c for c in integral_columns(indexed) if c in stat_cols]
    ranges = integral_magnitudes(indexed, integral)

    specs = [(kind, c) for c in stat_cols for kind in ("var_std", "skew_kurt", "quantiles")]
    specs += [("mean_std", c) for c in roll_cols]
    # the variance ranking and the final projection both need every window
    # column: write them once; what follows plans over a plain table
    out = written(sliding_statistics(indexed, specs, [], ranges, bucket_rows, total), "engineered")
    out = out.drop(IDX).fillna(0)
    out = extract_flow_features(out, flags=flag_columns(df), ports=port_columns(df)).frame
    feats = numeric_columns(out, exclude=[target, *TARGET_COLUMNS, order_col])
    out, pairs = create_interaction_features(out, feats)
    new = [c for c in out.columns if c not in df.columns]
    return Prepared(out, new, {"pairs": pairs})


def process_pipeline(df: DataFrame, key: str = "flow_seq", test_size: float = 0.2, seed: int = 42,
                     fit_scope: str = "train") -> Prepared:
    """Clean -> dataset features -> labels -> stratified split -> scale.

    ``fit_scope='train'`` fits the scaler on the training rows only;
    ``'all'`` fits on every row before the split.
    """
    # every fit step reads the cleaned rows: they are made once
    clean = written(clean_dataset(df), "cleaned")
    res = extract_features(clean, exclude=[key])
    enc, labels = encode_labels(res.frame)
    split = stratified_split(enc, "binary_label", key, test_size, seed)
    fit_on = split.where(~F.col("is_test")) if fit_scope == "train" else split
    scaled, scaler = normalize_features(split, res.feature_columns, fit_on=fit_on)
    return Prepared(scaled, res.feature_columns, {"scaler": scaler, "classes": labels.classes})


def adhoc_process(df: DataFrame, key: str = "flow_seq", clean: bool = True, features: bool = True,
                  labels: bool = True, scale: bool = True, select: str | None = "univariate",
                  k: int = 5) -> Prepared:
    """Toggle-driven processing of an uploaded table: clean, dataset and flow
    features, labels, scaling, then keep the top-``k`` features by the
    chosen score ('univariate' = ANOVA F, 'mutual_info' = binned, 'neighbors' =
    nearest-neighbour mutual information, 'importance' = random forest), in column order, with the label columns."""
    scorers = {"univariate": anova_f_scores, "mutual_info": mutual_info_scores, "neighbors": neighbor_mutual_info,
               "importance": rf_feature_importance}
    if select is not None and select not in scorers:
        raise ValueError(f"unknown selection {select!r}; one of {sorted(scorers)}")
    out = written(clean_dataset(df), "cleaned") if clean else df
    feats = numeric_columns(out, exclude=[*TARGET_COLUMNS, key])
    if features:
        base = extract_features(out, exclude=[key]).frame
        flow = extract_flow_features(base).frame
        out = flow
        feats = numeric_columns(out, exclude=[*TARGET_COLUMNS, key])
    if labels:
        out, _ = encode_labels(out)
    if scale:
        out, _ = normalize_features(out, feats)
    selected = feats
    if select and labels:
        ranked = scorers[select](out, feats, "binary_label").where(F.col("rank") <= k).collect()  # k rows
        best = {r["feature"] for r in ranked}
        selected = [c for c in feats if c in best]
        keep = [key] + selected + [c for c in ("label", "binary_label", "original_label") if c in out.columns]
        out = out.select(*keep)
    return Prepared(out, selected)
