"""Column statistics that stay distributed.

``exact_medians`` gives the exact, interpolated median of many columns
without gathering any column into one task: an approximate quantile sketch
brackets the median ranks, then only the values inside the bracket are
counted by distinct value. The bracket holds about ``6 n / accuracy`` rows; while
that is more than ``INSIDE_ROWS``, the values inside are bracketed again, so the
final per-column step is bounded no matter how large the table is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.columns import finite_or_null, is_float

DEFAULT_ACCURACY = 100_000
INSIDE_ROWS = 1_000_000   # values of one column that the last step may rank in one task


@dataclass
class MedianFit:
    medians: dict          # column -> median (None when the column is all missing)
    missing: dict          # column -> number of missing cells


def _as_double_clean(df: DataFrame, cols: list[str]) -> DataFrame:
    out = []
    for c in cols:
        x = F.col(c).cast("double")
        out.append((finite_or_null(x) if is_float(df, c) else x).alias(c))
    return df.select(*out)


def _narrowed(clean: DataFrame, bracket: dict, n: dict, accuracy: int, limit: int) -> dict:
    """Brackets whose values inside are at most ``limit`` rows, where ties allow it.

    A bracket is replaced by a sketch of the values inside it as long as the
    counted ranks show that the new one still holds both middle values.
    """
    eps = 3.0 / accuracy
    open_ = [c for c in bracket if n[c] > 0]
    kept = dict(bracket)
    inside: dict = {}
    while open_:
        aggs = []
        for i, c in enumerate(open_):
            lo, hi = bracket[c]
            aggs += [F.count_if(F.col(c) < F.lit(lo)).alias(f"b{i}"),
                     F.count_if((F.col(c) >= F.lit(lo)) & (F.col(c) <= F.lit(hi))).alias(f"i{i}")]
        row = clean.agg(*aggs).first()
        nxt = {}
        for i, c in enumerate(open_):
            below, held, (lo, hi) = row[f"b{i}"], row[f"i{i}"], bracket[c]
            k1, k2 = (n[c] - 1) // 2, n[c] // 2
            if not (below <= k1 and k2 < below + held) or held >= inside.get(c, n[c] + 1):
                continue                      # keep the last bracket that held the middle
            kept[c], inside[c] = (lo, hi), held
            if held > limit and lo < hi:
                nxt[c] = [min(1.0, max(0.0, (k - below + 0.5) / held + d)) for k, d in ((k1, -eps), (k2, eps))]
        if not nxt:
            break
        row = clean.agg(*[F.percentile_approx(F.when((F.col(c) >= F.lit(kept[c][0])) & (F.col(c) <= F.lit(kept[c][1])), F.col(c)),
                                              p, accuracy).alias(f"p{i}") for i, (c, p) in enumerate(nxt.items())]).first()
        bracket = {c: row[f"p{i}"] for i, c in enumerate(nxt)}
        open_ = list(nxt)
    return kept


def exact_medians(df: DataFrame, cols: list[str], only_with_missing: bool = False,
                  accuracy: int = DEFAULT_ACCURACY, inside_rows: int = INSIDE_ROWS) -> MedianFit:
    """Exact medians (NaN and +-Inf ignored) of ``cols`` in two passes.

    With ``only_with_missing`` the second pass runs only for columns that
    have a missing value (all that imputation needs).
    """
    if not cols:
        return MedianFit({}, {})
    clean = _as_double_clean(df, cols)
    eps = 1.0 / accuracy
    probs = [max(0.0, 0.5 - 3 * eps), min(1.0, 0.5 + 3 * eps)]
    if only_with_missing:
        # cheap counting pass first; sketch only the columns to impute
        row = clean.agg(*[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                        *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)]
                        ).collect()[0]
        n = {c: row[f"n{i}"] for i, c in enumerate(cols)}
        miss = {c: row[f"m{i}"] for i, c in enumerate(cols)}
        sketch = [c for c in cols if miss[c] > 0 and n[c] > 0]
        bracket = {}
        if sketch:
            row = clean.agg(*[F.percentile_approx(F.col(c), probs, accuracy).alias(f"b{i}")
                              for i, c in enumerate(sketch)]).collect()[0]
            bracket = {c: row[f"b{i}"] for i, c in enumerate(sketch)}
    else:
        aggs = []
        for i, c in enumerate(cols):
            aggs += [F.count(F.col(c)).alias(f"n{i}"),
                     F.count_if(F.col(c).isNull()).alias(f"m{i}"),
                     F.percentile_approx(F.col(c), probs, accuracy).alias(f"b{i}")]
        row = clean.agg(*aggs).collect()[0]           # one row: counts and brackets
        n = {c: row[f"n{i}"] for i, c in enumerate(cols)}
        miss = {c: row[f"m{i}"] for i, c in enumerate(cols)}
        bracket = {c: row[f"b{i}"] for i, c in enumerate(cols)}
    todo = [c for c in cols if n[c] > 0 and c in bracket]
    medians = {c: None for c in cols}
    if not todo:
        return MedianFit(medians, miss)

    if any(6 * n[c] > inside_rows * accuracy for c in todo):
        bracket = _narrowed(clean, {c: tuple(bracket[c]) for c in todo}, n, accuracy, inside_rows)

    # Last pass: rows below the bracket are only counted; rows inside are
    # counted per distinct value.
    parts = []
    for i, c in enumerate(todo):
        lo, hi = bracket[c]
        x = F.col(c)
        key = F.when(x < F.lit(lo), F.lit(None).cast("double")).otherwise(x)
        parts.append(F.when(x.isNotNull() & (x <= F.lit(hi)),
                            F.struct(F.lit(i).alias("ci"), key.alias("v"))))
    melted = (clean.select(F.explode(F.array(*parts)).alias("p"))
              .where(F.col("p").isNotNull())
              .select("p.ci", "p.v"))
    counts = melted.groupBy("ci", "v").agg(F.count(F.lit(1)).alias("cnt"))
    below = counts.where(F.col("v").isNull()).select("ci", F.col("cnt").alias("below"))
    inside = counts.where(F.col("v").isNotNull())
    w = Window.partitionBy("ci").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (inside.join(F.broadcast(below), "ci", "left")  # one row per column
              .withColumn("below", F.coalesce("below", F.lit(0)))
              .withColumn("cum", F.col("below") + F.sum("cnt").over(w)))
    targets = []
    for i, c in enumerate(todo):
        k1, k2 = (n[c] - 1) // 2, n[c] // 2   # 0-based ranks of the middle pair
        targets.append((i, k1, k2))
    tdf = df.sparkSession.createDataFrame(targets, "ci int, k1 long, k2 long")
    picked = (ranked.join(F.broadcast(tdf), "ci")
              .groupBy("ci")
              .agg(F.min(F.when(F.col("cum") > F.col("k1"), F.col("v"))).alias("v1"),
                   F.min(F.when(F.col("cum") > F.col("k2"), F.col("v"))).alias("v2"),
                   F.min(F.col("cum") - F.col("cnt")).alias("first_rank"),
                   F.max("cum").alias("last_rank"))
              .collect())                          # one row per column
    got = {r["ci"]: r for r in picked}
    fallback = []
    for i, k1, k2 in targets:
        r = got.get(i)
        c = todo[i]
        if r is None or r["v1"] is None or r["v2"] is None or r["first_rank"] > k1:
            fallback.append(c)
            continue
        medians[c] = (r["v1"] + r["v2"]) / 2.0
    if fallback:
        # The bracket missed the middle ranks (outside the sketch's error
        # bound): retry those columns with a 10x wider bracket.
        if accuracy <= 10:
            raise RuntimeError(f"median bracket failed for {fallback}")
        retry = exact_medians(df, fallback, False, max(10, accuracy // 10))
        medians.update(retry.medians)
    return MedianFit(medians, miss)
