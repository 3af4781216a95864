"""Joins to one row a key when a key may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hot_keys(rows: DataFrame, key: str, share: int = 1000) -> list[int]:
    """Hashes of the non-null keys that hold more than one in ``share`` of the
    rows, so fewer than ``share`` numbers. Counts are aggregated map-side."""
    total = rows.count()
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    return [r[0] for r in counts.where(F.col("count") * share > total).where("count > 1").select(F.xxhash64(key)).collect()]


def hot_of(table: DataFrame, key: str, n: str, total: int, share: int = 1000) -> list[int]:
    """The same from a table that has the rows of each key in column ``n``."""
    return [r[0] for r in table.where((F.col(n) * share > total) & (F.col(n) > 1)).select(F.xxhash64(key)).collect()]


def look_up(rows: DataFrame, table: DataFrame, key: str, share: int = 1000, counted: DataFrame | None = None,
            hot: list[int] | None = None, nulls: bool = True) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has at most one row a key.
    ``counted``: a cheaper table with the same keys as often, to count them in;
    ``hot``: hashes of the hot keys, where the caller knows them; ``nulls``:
    whether the key can be null at all.

    Rows of hot keys take theirs from a broadcast of fewer than ``share`` rows
    where they lie; the others are shuffled, no key of them holding more than
    one in ``share`` of the rows. (Keys are told apart by their hash, in both
    tables alike; a key whose hash is that of a hot one is merely broadcast
    too.) Null keys find nothing and are not shuffled.
    """
    hot = hot_keys(rows if counted is None else counted, key, share) if hot is None else hot
    is_hot = F.xxhash64(key).isin(hot)
    known = rows.where(F.col(key).isNotNull()) if nulls else rows
    if not hot:
        found = known.join(table, key, "left")
    else:
        found = known.where(~is_hot).join(table.where(~is_hot), key, "left").unionByName(
            known.where(is_hot).join(F.broadcast(table.where(is_hot)), key, "left"))
    if not nulls:
        return found
    return found.unionByName(rows.where(F.col(key).isNull()).select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != key]))
