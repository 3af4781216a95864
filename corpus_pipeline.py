"""Documents to packed training sequences.

Each stage applies one operator of ``flowsieve.llm`` to what its predecessor
kept; its rows are written as Parquet below the session's checkpoint folder and
read again as the next stage's documents.

All stages take rows with null ids, null or empty texts, repeated rows and
further columns of any name, and no rows; each says what becomes of them. Null
and empty texts pass or fail the first stage by the score of an empty text, are
equal to each other in the second, pass the third, and have no words to mix in
the fourth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsieve.llm.exact_dedup import drop_exact_duplicates
from flowsieve.llm.minhash_tensor import NearDupConfig, drop_near_duplicates
from flowsieve.llm.mixing import mixed_documents
from flowsieve.llm.packing_dp import PackConfig, pack_documents
from flowsieve.llm.quality_conv import fit_quality, keep_quality
from flowsieve.session import written as stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts; it learns from the labelled
    rows of the stage's input. Rows without an id are judged by the same score;
    an empty table stays empty."""
    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of equal texts; a group without ids
    keeps one row."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicate texts (five-word
    shingles, similarity 0.8); rows without an id come behind all that have one.
    Texts without words are kept."""
    return drop_near_duplicates(docs, NearDupConfig())


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mix takes: a row per document and pass over its source;
    rows without a doc_id are documents too."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences; a text without tokens is
    its closing id, null ids are packed first."""
    import public_tokenizers

    return pack_documents(docs, PackConfig(str(public_tokenizers.path("byte_bpe_50k.json"))))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# Learned scores, minhashes and pseudorandom draws have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
