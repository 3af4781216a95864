"""Feature statistics and selection: variance ranking, interactions, ANOVA F,
binned mutual information.

Statistics of all columns come from one wide aggregate over the rows; only its
few result rows are turned into long format.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.columns import r6
from flowsieve.functions.formulas import interaction_terms


def melt(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """Long format (``*keep``, feature, value double)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value"))
                      for c in cols])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.value")


def column_variances(df: DataFrame, cols: list[str]) -> dict:
    """Sample variance of each column (one aggregate row)."""
    row = df.agg(*[F.var_samp(F.col(f"`{c}`").cast("double")).alias(f"v{i}")
                   for i, c in enumerate(cols)]).collect()[0]
    return {c: row[f"v{i}"] for i, c in enumerate(cols)}


def top_variance_columns(df: DataFrame, cols: list[str], k: int = 10) -> list[str]:
    """The ``k`` columns of largest variance, largest first (all columns in
    their order when there are at most ``k``)."""
    if len(cols) <= k:
        return list(cols)
    var = column_variances(df, cols)
    order = sorted(range(len(cols)), key=lambda i: (-(var[cols[i]] if var[cols[i]] is not None
                                                        and not math.isnan(var[cols[i]]) else -math.inf), i))
    return [cols[i] for i in order[:k]]


def interaction_pairs(top: list[str], span: int = 4, max_pairs: int = 20) -> list[tuple[str, str]]:
    pairs = [(top[i], top[j]) for i in range(len(top)) for j in range(i + 1, min(i + span, len(top)))]
    return pairs[:max_pairs]


def create_interaction_features(df: DataFrame, cols: list[str], pairs=None) -> tuple[DataFrame, list]:
    """Product, ratio and difference per pair (auto pairs from the top-10
    variance columns); non-finite results become 0."""
    if pairs is None:
        pairs = interaction_pairs(top_variance_columns(df, cols))
    new = {}
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            new.update(interaction_terms(a, b))
    fixed = {k: F.coalesce(F.when(F.isnan(v) | v.isin(float("inf"), float("-inf")), None).otherwise(v),
                           F.lit(0.0)) for k, v in new.items()}
    keep = [F.col(f"`{c}`") for c in df.columns if c not in fixed]
    return df.select(*keep, *[v.alias(k) for k, v in fixed.items()]), pairs


def anova_f_scores(df: DataFrame, cols: list[str], y: str) -> DataFrame:
    """One-way ANOVA F per feature: (SSB/(k-1)) / (SSW/(n-k)), from one
    grouped aggregate of (feature, class). Columns: feature, f_score, rank
    (1 = best; ties by name)."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    per_class = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n_g"), F.col(f"m{i}").alias("mean_g"),
                                   F.col(f"v{i}").alias("var_g")) for i, c in enumerate(cols)])
    g = (df.groupBy(y).agg(*aggs).select(y, F.explode(per_class).alias("s"))      # one row per class and feature
         .select("s.feature", y, "s.n_g", "s.mean_g", "s.var_g").where("n_g > 0"))
    wf = Window.partitionBy("feature")               # one group per feature: k class rows
    g = g.select("*", F.sum("n_g").over(wf).alias("n"),
                 (F.sum(F.col("n_g") * F.col("mean_g")).over(wf) / F.sum("n_g").over(wf)).alias("mean"),
                 F.count(F.lit(1)).over(wf).alias("k"))
    per = g.groupBy("feature").agg(
        F.sum(F.col("n_g") * (F.col("mean_g") - F.col("mean")) ** 2).alias("ssb"),
        F.sum(F.col("n_g") * F.col("var_g")).alias("ssw"),
        F.first("n").alias("n"), F.first("k").alias("k"))
    f = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k")))
    scored = per.select("feature", f.alias("f_score"))
    # one row per feature; scores equal to 6 places tie and fall back to the name
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last(r6(F.col("f_score"))), "feature"))
    return scored.select("*", rank.alias("rank"))


def mutual_info_scores(df: DataFrame, cols: list[str], y: str, bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) between each equal-width-binned
    feature and the class. Columns: feature, mi, rank."""
    values = [F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))) for c in cols]
    rng = df.agg(*[f(x).alias(f"{f.__name__}{i}") for i, x in enumerate(values) for f in (F.min, F.max)]).first()
    pairs = []
    for i, (c, x) in enumerate(zip(cols, values)):
        lo, hi = rng[f"min{i}"], rng[f"max{i}"]
        if lo is None:
            continue
        width = (hi - lo) / bins
        b = F.lit(0) if width == 0 else F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        pairs.append(F.when(x.isNotNull(), F.struct(F.lit(c).alias("feature"), b.cast("int").alias("bin"))))
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature string, mi double, rank int")
    binned = df.select(y, F.explode(F.array_compact(F.array(*pairs))).alias("p")).select("p.feature", y, "p.bin")
    joint = binned.groupBy("feature", "bin", y).agg(F.count(F.lit(1)).alias("n_by"))
    wf = Window.partitionBy("feature")
    wb = Window.partitionBy("feature", "bin")
    wy = Window.partitionBy("feature", y)
    j = joint.select("*", F.sum("n_by").over(wf).alias("n"), F.sum("n_by").over(wb).alias("n_b"),
                     F.sum("n_by").over(wy).alias("n_y"))
    term = (F.col("n_by") / F.col("n")) * F.log(F.col("n_by") * F.col("n") / (F.col("n_b") * F.col("n_y")))
    mi = j.groupBy("feature").agg(F.sum(term).alias("mi"))
    rank = F.row_number().over(Window.orderBy(F.desc(r6(F.col("mi"))), "feature"))  # one row per feature
    return mi.select("*", rank.alias("rank"))
