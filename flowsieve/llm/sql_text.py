"""Text measures as column expressions (white space is ``[\\x20\\x09-\\x0D]``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_RUNS = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def collapsed(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUNS, " ")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null has none."""
    body = F.trim(collapsed(text))
    spaces = F.octet_length(body) - F.octet_length(F.replace(body, F.lit(" "), F.lit("")))
    return F.when(body == "", 0).otherwise(spaces + 1).cast("long")


def held_out() -> Column:
    """crc32 of the doc_id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """The table with a broadcast hint if its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
