"""Label encoding and the exact stratified train/test split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.operators.ordering import dense_index
from flowsieve.schema import BENIGN_LABELS

EDGE_SPACE_RE = r"(?U)^\s+|\s+$"
LITERAL_CLASSES = 1000   # above this many classes the index is joined, not written into the plan


def normalized_label(c: Column) -> Column:
    """str -> strip (any white space) -> upper; a missing label reads as 'NAN'."""
    return F.coalesce(F.upper(F.regexp_replace(c.cast("string"), EDGE_SPACE_RE, "")), F.lit("NAN"))


def binary_label(norm: Column) -> Column:
    return F.when(norm.isin(*BENIGN_LABELS), 0).otherwise(1)


@dataclass
class LabelFit:
    classes: list          # sorted normalised class names; index = position


def fit_labels(df: DataFrame, target: str = "label") -> LabelFit:
    """Sorted distinct normalised labels: one row per class of the model."""
    rows = df.select(normalized_label(F.col(target)).alias("c")).distinct().collect()
    return LabelFit(sorted(r["c"] for r in rows))


def encode_labels(df: DataFrame, target: str = "label", fit: LabelFit | None = None) -> tuple[DataFrame, LabelFit]:
    """Add ``binary_label`` (0 benign / 1 other) and ``original_label``;
    replace ``target`` with the class index in sorted class order."""
    if target not in df.columns:
        return df, LabelFit([])
    fit = fit or fit_labels(df, target)
    norm = normalized_label(F.col(target))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (target, "binary_label", "original_label")]
    if len(fit.classes) <= LITERAL_CLASSES:
        mapping = F.create_map(*[x for i, name in enumerate(fit.classes) for x in (F.lit(name), F.lit(i))])
        index = F.element_at(mapping, norm).cast("int")
    else:
        table = df.sparkSession.createDataFrame(list(enumerate(fit.classes)), "_class int, _norm string")
        df = df.join(table, norm == F.col("_norm"), "left")
        index = F.col("_class")
    out = df.select(*keep,
                    index.alias(target),
                    binary_label(norm).alias("binary_label"),
                    F.col(target).alias("original_label"))
    return out, fit


def split_quotas(class_counts: dict, test_size: float) -> dict:
    """Per-class test quota: proportional with largest remainders.

    The total is ceil(test_size * n) as in the usual stratified split.
    """
    import math
    n = sum(class_counts.values())
    n_test = int(math.ceil(test_size * n))
    base = {k: (n_test * v) // n for k, v in class_counts.items()}
    rem = sorted(class_counts, key=lambda k: (-((n_test * class_counts[k]) % n), str(k)))
    left = n_test - sum(base.values())
    for k in rem[:left]:
        base[k] += 1
    return base


def draw_key(seed: int, key: Column) -> Column:
    """Deterministic pseudo-random draw order: md5 of seed and row key."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), key.cast("string")))


def stratified_split(df: DataFrame, y: str = "binary_label", key: str = "flow_seq",
                     test_size: float = 0.2, seed: int = 42,
                     num_partitions: int | None = None) -> DataFrame:
    """Exact per-class proportional split; adds ``is_test`` (boolean). Rows
    without a class are a class of their own; classes may be of any type.

    Rows are ranked inside their class by ``md5(seed:key)`` through a
    range-partitioned dense index, so a large class is spread over many tasks
    instead of one window partition per class.
    """
    counts = {r[y]: r["n"] for r in df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        raise ValueError("no rows to split")
    quotas = split_quotas(counts, test_size)
    spark = df.sparkSession
    key_type = df.schema[y].dataType.simpleString()
    qdf = spark.createDataFrame([(k, int(v)) for k, v in quotas.items()], f"_class {key_type}, _quota long")
    ranked = dense_index(df.withColumn("_draw", draw_key(seed, F.col(key))),
                         [y, "_draw", key], num_partitions)
    start = ranked.groupBy(F.col(y).alias("_class")).agg(F.min("_idx").alias("_start"))   # one row per class
    per = start.join(qdf.withColumnRenamed("_class", "_c"), F.col("_class").eqNullSafe(F.col("_c"))).drop("_c")
    per = F.broadcast(per) if len(quotas) <= LITERAL_CLASSES else per
    out = (ranked.join(per, F.col(y).eqNullSafe(F.col("_class")))
           .withColumn("is_test", (F.col("_idx") - F.col("_start")) < F.col("_quota")))
    return out.drop("_draw", "_idx", "_start", "_quota", "_class")
