"""Mutual information of a numeric feature and a class by nearest neighbours.

For a row whose class has N_y rows, r is the distance to the k-th nearest other
row of its class (all of them if the class has fewer), and m the number of rows
of any class within r, the row itself included. The estimate is

    psi(N) + mean psi(k) - mean psi(N_y) - mean psi(m)       (not below 0)

over the rows of classes with more than one row. *Tie rule:* rows at distance
exactly r are not counted, unless r is 0: then m counts the equal values. No
noise is added, so the result does not depend on a random draw.

Rows of equal feature, value and class are counted together first, so a value
that most rows share is one row of the rest. Neighbours are then at most k rows
away in (feature, class, value) order: the ordered rows are cut into buckets
that carry the k rows before and after. The range counts are differences of one
distributed running total over values and interval ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.columns import r6
from flowsieve.operators.ordering import IDX, bucket_size, dense_index_with_total, running_totals
from flowsieve.operators.selection import melt
from flowsieve.session import written


def digamma(x: Column) -> Column:
    """psi for x >= 1: six steps of its recurrence, then its asymptotic series."""
    z = x.cast("double") + 6.0
    i = 1.0 / (z * z)
    series = F.log(z) - 0.5 / z - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i * (1 / 132)))))
    for step in range(6):
        series = series - 1.0 / (x.cast("double") + float(step))
    return series


def both_sides(ordered: DataFrame, partition_cols: list[str], reach: int, build, total: int,
               bucket_rows: int | None = None) -> DataFrame:
    """Window columns that look up to ``reach`` rows back and ahead of a dense
    index: buckets hold copies of the ``reach`` rows on either side."""
    size = bucket_rows or bucket_size(ordered.sparkSession, total, reach)
    if size <= reach:
        raise ValueError("bucket_rows must exceed the reach")
    idx = F.col(IDX)
    own = F.floor(idx / size).cast("long")
    at = idx % size
    copies = F.array_compact(F.array(own, F.when(at >= size - reach, own + 1), F.when(at < reach, own - 1)))
    parts = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = ordered.select("*", own.alias("_own"), F.explode(copies).alias("_bucket")).repartition(parts, "_bucket")
    w = Window.partitionBy("_bucket", *partition_cols).orderBy(IDX)
    return spread.select("*", *build(w)).where("_bucket = _own").drop("_bucket", "_own")


def neighbor_mutual_info(df: DataFrame, cols: list[str], y: str, k: int = 3, bucket_rows: int | None = None) -> DataFrame:
    """Columns feature, mi (nats), rank (1 = most; ties by name), a row for each
    of ``cols``. Missing and non-finite values and rows without a class take no
    part; a feature without two rows of one class has mi 0. An empty table gives
    0 for every feature."""
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = df.sparkSession
    classed = df.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{y}`").cast("string").alias("_class"))
    cells = (melt(classed, cols, ["_class"]).withColumnRenamed("_class", "y")
             .where("y is not null and value is not null and not isnan(value) and abs(value) < double('infinity')")
             .withColumn("value", F.col("value") + F.lit(0.0))  # -0.0 is 0.0
             .groupBy("feature", "y", "value").agg(F.count(F.lit(1)).alias("n")))
    cells = written(cells, "mi-cells")
    sizes = cells.groupBy("feature", "y").agg(F.sum("n").alias("n_y")).where("n_y > 1")
    # a row for each feature and class; not more than classes times columns
    indexed, total = dense_index_with_total(cells, ["feature", "y", "value"])

    def neighbours(w):
        steps = [(F.lag, j) for j in range(1, k + 1)] + [(F.lead, j) for j in range(1, k + 1)]
        found = [F.struct(F.abs(f("value", j).over(w) - F.col("value")).alias("d"), f("n", j).over(w).alias("c")) for f, j in steps]
        return [F.array(F.struct(F.lit(0.0).alias("d"), (F.col("n") - 1).alias("c")), *found).alias("near")]

    near = both_sides(indexed, ["feature", "y"], k, neighbours, total, bucket_rows)
    near = near.join(sizes, ["feature", "y"]).withColumn("k", F.least(F.lit(k), F.col("n_y") - 1))
    ordered = F.array_sort(F.filter("near", lambda s: s["d"].isNotNull()))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0.0).alias("r"))
    walked = F.aggregate(ordered, start, lambda acc, s: F.struct(
        (acc["seen"] + s["c"]).alias("seen"), F.when(acc["seen"] < F.col("k"), s["d"]).otherwise(acc["r"]).alias("r")))
    points = written(near.select(IDX, "feature", "value", "n", "n_y", "k", walked["r"].alias("r")), "mi-points")

    # ends in the order of values: an end before the rows of its value is 0, behind them 2
    tight = F.col("r") == 0
    events = points.select("feature", IDX, "n", F.explode(F.array(
        F.struct(F.col("value").alias("at"), F.lit(1).alias("tag"), F.lit(0).alias("sign")),
        F.struct((F.col("value") - F.col("r")).alias("at"), F.when(tight, 0).otherwise(2).alias("tag"), F.lit(-1).alias("sign")),
        F.struct((F.col("value") + F.col("r")).alias("at"), F.when(tight, 2).otherwise(0).alias("tag"), F.lit(1).alias("sign")))).alias("e"))
    events = events.select("feature", F.col("e.at").alias("at"), F.col("e.tag").alias("tag"), F.col("e.sign").alias("sign"),
                           F.col(IDX).alias("point"), F.when(F.col("e.sign") == 0, F.col("n")).otherwise(0).alias("rows"))
    counted = running_totals(events, ["feature", "at", "tag", "sign", "point"], {"upto": F.col("rows")}, bucket_rows)
    within = counted.where("sign != 0").groupBy("point").agg(F.sum(F.col("sign") * F.col("upto")).alias("m"))

    terms = points.join(within, points[IDX] == within["point"])
    per = terms.groupBy("feature").agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") * (digamma(F.col("k")) - digamma(F.col("n_y")) - digamma(F.col("m")))).alias("s"))
    scored = per.select("feature", F.greatest(F.lit(0.0), digamma(F.col("rows")) + F.col("s") / F.col("rows")).alias("mi"))
    names = spark.createDataFrame([(c,) for c in cols], "feature string")
    scored = names.join(scored, "feature", "left").select("feature", F.coalesce("mi", F.lit(0.0)).alias("mi"))
    return scored.select("*", F.row_number().over(Window.orderBy(F.desc(r6(F.col("mi"))), "feature")).alias("rank"))
