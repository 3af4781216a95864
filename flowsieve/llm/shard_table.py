"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: a
start and a step hashed from its name, so that each order visits every slot
once. The shards take turns claiming their next free slot until the table is
full. Shares are equal to within one slot (or follow integer weights), and
when a shard joins or leaves, few other slots change hands. A row's key hashes
to a slot, and the table, whose size is a parameter, is broadcast.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class ShardConfig:
    """``slots`` must be prime, well above the number of shards; a shard of
    weight w claims w slots a turn."""

    shards: tuple[str, ...] = field(default_factory=lambda: tuple(f"shard-{i:04d}" for i in range(256)))
    slots: int = 65537
    weights: dict[str, int] = field(default_factory=dict)


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def fill_table(cfg: ShardConfig) -> np.ndarray:
    """Shard index of each slot."""
    if not cfg.shards or len(set(cfg.shards)) < len(cfg.shards):
        raise ValueError("shards must be distinct names, at least one")
    if not _is_prime(cfg.slots) or cfg.slots < len(cfg.shards):
        raise ValueError("slots must be a prime not below the number of shards")
    at = [_number(s, "start") % cfg.slots for s in cfg.shards]
    step = [_number(s, "step") % (cfg.slots - 1) + 1 for s in cfg.shards]
    turns = [max(1, cfg.weights.get(s, 1)) for s in cfg.shards]
    table = [-1] * cfg.slots
    free = cfg.slots
    while free:
        for i in range(len(cfg.shards)):
            for _ in range(min(turns[i], free)):
                while table[at[i]] >= 0:
                    at[i] = (at[i] + step[i]) % cfg.slots
                table[at[i]] = i
                free -= 1
    return np.array(table, dtype=np.int32)


def assign_shards(rows: DataFrame, key: Column, cfg: ShardConfig = ShardConfig()) -> DataFrame:
    """The rows with columns slot (long) and shard (its name) added, or replaced
    where the input has columns of these names.

    Equal keys go to one shard, null keys together; an empty table gives an
    empty one. Rows are not moved: write with partitionBy("shard") or
    repartition by it.
    """
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, cfg.shards[s]) for i, s in enumerate(fill_table(cfg).tolist())], "at long, name string")
    placed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
                         F.pmod(F.xxhash64(key.cast("string")), F.lit(cfg.slots)).alias("at"))
    found = placed.join(F.broadcast(table), "at", "left")
    new = {"slot": F.col("at"), "shard": F.col("name")}
    names = [*rows.columns, *[c for c in new if c not in rows.columns]]
    return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in names])
