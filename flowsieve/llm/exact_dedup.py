"""Exact duplicates by salted combining.

Texts are equal when identical after each white-space run becomes one space.
Copies are combined in three steps, and each step groups by the digest *and*
the full normalised text, so two texts that share a digest are never merged:

1. each task combines the copies it reads (map-side aggregation);
2. (digest, salt) groups combine across tasks: a text that holds a third of
   all rows is spread over ``salts`` groups;
3. the salt winners of a text combine: at most ``salts`` rows a text.

The rows then look up their group by digest alone, which the grouping has shown
to be one text each; only digests found with several texts are looked up with
the text as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from flowsieve.llm.sql_text import collapsed
from flowsieve.session import written as stored


def _sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def exact_duplicates(docs: DataFrame, salts: int = 16, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id (smallest doc_id of the equal
    texts), group_size, kept, text_sha256.

    Needs doc_id and text; other columns are not read. Null texts are empty
    ones, and empty texts are equal to each other. Null doc_ids never win
    unless the group has no other (keep_id is null then, and one row of the
    group is kept). Of rows that repeat the winning doc_id and text one is
    kept. An empty table gives an empty table. ``digest`` may be replaced by a
    weaker one: the result stays the same.
    """
    text = collapsed(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("body")) \
               .withColumn("digest", digest(F.col("body")))
    salted = (rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
              .groupBy("digest", "salt", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")))
    winners = (salted.groupBy("digest", "body")
               .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")))
    groups = stored(winners.groupBy("digest").agg(
        F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")),
        "dedup-groups")

    sha = _sha256(F.col("body")).alias("text_sha256")
    found = (rows.select("doc_id", "digest", sha)
             .join(groups.where("texts = 1"), "digest").select("doc_id", "keep_id", "group_size", "text_sha256"))
    shared = groups.where("texts > 1").select("digest")
    if shared.head(1):
        clash = rows.join(shared, "digest").join(winners.join(shared, "digest"), ["digest", "body"])
        found = found.unionByName(clash.select("doc_id", "keep_id", "group_size", sha))
    copy = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("keep_id"))
    return found.select("doc_id", "keep_id", "group_size",
                        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (copy == 1)).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row of each group of equal texts, all its columns: that of the
    smallest doc_id. Null and empty texts are equal. A group without any doc_id
    keeps one of its rows, and of rows that repeat the winning doc_id and text
    one stays. Columns besides doc_id and text may have any name. An empty
    table gives an empty table."""
    kept = exact_duplicates(docs, salts).where("kept").select("doc_id", "text_sha256")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"), _sha256(collapsed(F.col("text"))).alias("sha"))
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["sha"] == kept["text_sha256"])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "sha"]).select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
