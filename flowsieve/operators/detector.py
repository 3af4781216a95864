"""The flow detector: raw flows in, attack probability or anomaly score out.

A detector holds all that scoring needs, learned once from its training rows:
medians that fill missing cells, the derived features, the scaler, the class
index and the network. It is saved and loaded as one Parquet row, so another
process scores raw flows with the same numbers.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.functions.columns import finite_or_null, float_columns, numeric_columns
from flowsieve.operators import dense_net as dn
from flowsieve.operators.features import (extract_features, extract_flow_features, flag_columns, port_columns,
                                          protocol_values)
from flowsieve.operators.labels import binary_label, fit_labels, normalized_label
from flowsieve.operators.scale import fit_scaler
from flowsieve.operators.stats import exact_medians
from flowsieve.schema import TARGET_COLUMNS


@dataclass
class FeaturePlan:
    """How raw flows become network inputs. ``medians``: fills of the raw
    numeric columns; ``protocols``, ``flags``, ``ports``: what the flow features
    are made of (None: dataset features only); ``features`` with their means and
    standard deviations; ``classes``: label names by index."""

    medians: dict = field(default_factory=dict)
    protocols: list | None = None
    flags: list | None = None
    ports: list | None = None
    features: list = field(default_factory=list)
    means: dict = field(default_factory=dict)
    stds: dict = field(default_factory=dict)
    classes: list = field(default_factory=list)


def _derived(flows: DataFrame, plan: FeaturePlan, key: str) -> DataFrame:
    floats = set(float_columns(flows))
    out = flows.select(*[finite_or_null(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in flows.columns])
    fills = {c: m for c, m in plan.medians.items() if c in out.columns and m is not None}
    out = extract_features(out.fillna(fills) if fills else out, exclude=[key]).frame
    if plan.flags is not None:
        out = extract_flow_features(out, protocols=plan.protocols, flags=plan.flags, ports=plan.ports).frame
    return out


def fit_plan(flows: DataFrame, key: str, label: str | None = "label", flow_features: bool = False,
             exclude: tuple = ()) -> FeaturePlan:
    """Learn medians, feature names and scaling from raw training flows."""
    skip = [key, *TARGET_COLUMNS, *exclude]
    raw = numeric_columns(flows, exclude=skip)
    plan = FeaturePlan(medians=exact_medians(flows, raw).medians)
    if flow_features:
        plan.protocols = protocol_values(flows) if "protocol" in flows.columns else []
        plan.flags, plan.ports = flag_columns(flows), port_columns(flows)
    derived = _derived(flows, plan, key)
    plan.features = numeric_columns(derived, exclude=skip)
    scaler = fit_scaler(derived, plan.features)
    plan.means, plan.stds = scaler.means, scaler.stds
    if label and label in flows.columns:
        plan.classes = fit_labels(flows, label).classes
    return plan


def network_inputs(plan: FeaturePlan) -> Column:
    """The scaled features as an array; a missing or non-finite value is the mean."""
    out = []
    for c in plan.features:
        mean, std = plan.means[c], plan.stds[c]
        if mean is None or not std:
            out.append(F.lit(0.0))
        else:
            z = (F.col(f"`{c}`").cast("double") - F.lit(mean)) / F.lit(std)
            out.append(F.coalesce(finite_or_null(z), F.lit(0.0)))
    return F.array(*out)


@dataclass
class FlowDetector:
    plan: FeaturePlan
    network: dn.Network
    key: str

    def score(self, flows: DataFrame, column: str = "prob") -> DataFrame:
        """The raw flows with the network's output in ``column``: attack
        probability, or reconstruction error. Batch and streaming alike."""
        derived = _derived(flows, self.plan, self.key)
        kept = [F.col(f"`{c}`") for c in derived.columns if c != column]
        return derived.select(*kept, dn.network_output(flows.sparkSession, self.network, network_inputs(self.plan)).alias(column))

    def save(self, spark: SparkSession, path: str) -> None:
        dn.save_network(spark, self.network, path, {"plan": asdict(self.plan), "key": self.key})

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FlowDetector":
        network, extra = dn.load_network(spark, path)
        return FlowDetector(FeaturePlan(**extra["plan"]), network, extra["key"])

    def history(self, spark: SparkSession) -> DataFrame:
        """A row per epoch."""
        return spark.createDataFrame(self.network.history, "epoch int, loss double, validation_loss double, learning_rate double")


def train_flow_detector(flows: DataFrame, key: str = "flow_seq", label: str = "label", hidden=(256, 128, 64, 32),
                        dropout: float = 0.3, flow_features: bool = False, cfg: dn.TrainConfig = dn.TrainConfig(),
                        exclude: tuple = ()) -> FlowDetector:
    """A binary detector (benign or not) from raw labelled flows. Rows with a
    missing label are malicious, as in ``encode_labels``."""
    plan = fit_plan(flows, key, label, flow_features, exclude)
    target = F.col("_target")
    rows = _derived(flows.withColumn("_target", binary_label(normalized_label(F.col(label)))), plan, key)
    net = dn.new_network(dn.classifier_layers(hidden, dropout), len(plan.features), "logistic", cfg.seed)
    return FlowDetector(plan, dn.train_network(net, rows, network_inputs(plan), target, key, cfg), key)


def train_reconstruction(flows: DataFrame, key: str = "flow_seq", code: int = 32, wide=(128, 64), dropout: float = 0.3,
                         flow_features: bool = False, cfg: dn.TrainConfig = dn.TrainConfig(),
                         exclude: tuple = ()) -> FlowDetector:
    """An encoder and decoder trained to give back their inputs; ``score`` is
    the mean squared error of each row, large for flows unlike those it was
    trained on. No labels are read."""
    plan = fit_plan(flows, key, None, flow_features, exclude)
    net = dn.new_network(dn.autoencoder_layers(len(plan.features), code, wide, dropout), len(plan.features), "squares", cfg.seed)
    return FlowDetector(plan, dn.train_network(net, _derived(flows, plan, key), network_inputs(plan), None, key, cfg), key)
