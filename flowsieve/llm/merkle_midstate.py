"""Merkle manifest of a table, folded from SHA-256 midstates.

A row's leaf is the SHA-256 of its fields. The leaves of a group (a language)
are a tree: while several nodes remain, every ``arity`` consecutive ones become
the hash of their digests. The groups' roots, in group order, give the root the
same way.

A parent's hash runs over its children from left to right, so its state before
a child's slot depends on the children to the left alone. A parent therefore
retains a copy of the hash state before each slot. To see what the root becomes
when one leaf changes, the fold resumes, level by level, the state before the
node's slot with the replacement and the siblings to the right; what stands to
the left is not hashed again.

Trees are cut into chunks of ``arity ** depth`` consecutive nodes (4,096), so a
task holds one chunk of any group, and a group of any size is spread over as
many tasks. Upwards, each chunk gives its top node, and those are the nodes of
the next storey; downwards, each chunk learns the siblings on the way from its
top to the root, and its nodes theirs. Only the number of storeys is known to
the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowsieve.llm.hot_keys import look_up
from flowsieve.operators.ordering import dense_index
from flowsieve.session import written as stored

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class MerkleConfig:
    """``group``: the column whose values have trees of their own; ``order``:
    the column that orders a group's leaves; ``fields``: what a leaf covers."""

    group: str = "lang"
    order: str = "doc_id"
    fields: tuple[str, ...] = tuple(FIELDS)
    arity: int = 8
    depth: int = 4

    @property
    def chunk(self) -> int:
        return self.arity ** self.depth


def leaf_hash(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields: ``-`` for null, else the number of
    UTF-8 bytes, ``:`` and the value."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


class Parents:
    """One level of hashes over consecutive runs of ``arity`` nodes: their
    digests and, for each node, the state before its slot and its siblings."""

    def __init__(self, nodes: list[str], arity: int):
        self.digests, self.before, self.left, self.right = [], [], [], []
        for at in range(0, len(nodes), arity):
            run = nodes[at:at + arity]
            state = hashlib.sha256()
            for i, node in enumerate(run):
                self.before.append(state.copy())
                self.left.append("".join(run[:i]))
                self.right.append("".join(run[i + 1:]))
                state.update(node.encode())
            self.digests.append(state.hexdigest())

    def fold(self, i: int, replacement: str) -> str:
        """The parent's digest with ``replacement`` in the slot of node i."""
        return _resume(self.before[i], replacement, self.right[i])


def _resume(before, replacement: str, right: str) -> str:
    state = before.copy()
    state.update((replacement + right).encode())
    return state.hexdigest()


def _levels(nodes: list[str], total: int, cfg: MerkleConfig) -> list[Parents]:
    """The levels above a chunk: all ``depth`` of them if its tree has further
    chunks, else until one node remains."""
    levels: list[Parents] = []
    while (len(levels) < cfg.depth) if total > cfg.chunk else len(nodes) > 1:
        levels.append(Parents(nodes, cfg.arity))
        nodes = levels[-1].digests
    return levels


def _top(cfg: MerkleConfig):
    """A chunk's top node, a node of the storey above."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        nodes, total = table.column("digest").to_pylist(), table.column("total")[0].as_py()
        levels = _levels(nodes, total, cfg)
        return pa.table({"tree": table.column("tree").slice(0, 1), "pos": table.column("chunk").slice(0, 1),
                         "total": pa.array([-(-total // cfg.chunk)], pa.int64()),
                         "digest": [levels[-1].digests[0] if levels else nodes[0]]})
    return run


_WAY = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_WAY_DDL = "array<struct<left: string, right: string>>"
_WAYS = f"tree long, chunk long, way {_WAY_DDL}, subroot string"


def _ways(cfg: MerkleConfig, top: bool):
    """For each node of a chunk, given the way from the chunk's top, the
    siblings of every level up to the root. The nodes of the ``top`` tree are
    the subroots."""
    def run(nodes: pa.Table, given: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        digests = nodes.column("digest").to_pylist()
        levels = _levels(digests, nodes.column("total")[0].as_py(), cfg)
        above = given.column("way")[0].as_py() if given.num_rows else []
        ways = []
        for i in range(len(digests)):
            at, way = i, []
            for level in levels:
                way.append({"left": level.left[at], "right": level.right[at]})
                at //= cfg.arity
            ways.append(way + above)
        subroot = digests if top else given.column("subroot").to_pylist() * len(digests)
        return pa.table({"tree": nodes.column("tree"), "chunk": nodes.column("pos"), "way": pa.array(ways, _WAY),
                         "subroot": pa.array(subroot, pa.string())})
    return run


def _folded(cfg: MerkleConfig):
    """proof_sha256 and folded_root of each leaf of a chunk."""
    def run(nodes: pa.Table, given: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        digests = nodes.column("digest").to_pylist()
        levels = _levels(digests, nodes.column("total")[0].as_py(), cfg)
        above = [(hashlib.sha256(step["left"].encode()), step["right"], step["left"] + step["right"])
                 for step in given.column("way")[0].as_py()]
        proofs, roots = [], []
        for i, now in enumerate(nodes.column("changed").to_pylist()):
            at, proof = i, []
            for level in levels:
                now = level.fold(at, now)
                proof.append(level.left[at] + level.right[at])
                at //= cfg.arity
            for state, right, siblings in above:
                now = _resume(state, now, right)
                proof.append(siblings)
            proofs.append(hashlib.sha256("".join(proof).encode()).hexdigest())
            roots.append(now)
        return pa.table({"id": nodes.column("id"), "leaf": nodes.column("digest"),
                         "subroot": pa.array(given.column("subroot").to_pylist() * len(digests), pa.string()),
                         "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(roots, pa.string())})
    return run


def _chunked(nodes: DataFrame, cfg: MerkleConfig) -> DataFrame:
    return nodes.withColumn("chunk", F.floor(F.col("pos") / cfg.chunk).cast("long"))


def _storeys(nodes: DataFrame, cfg: MerkleConfig) -> tuple[list[DataFrame], DataFrame]:
    """The storeys from the bottom (tree, pos, total, digest, chunk) and the
    trees' roots (tree, pos 0, total 1, digest)."""
    storeys = []
    while True:
        storeys.append(_chunked(nodes, cfg))
        plain = storeys[-1].select("tree", "chunk", "pos", "total", "digest")
        nodes = stored(plain.groupBy("tree", "chunk").applyInArrow(
            _top(cfg), "tree long, pos long, total long, digest string"), "merkle-tops")
        if not nodes.where("total > 1").head(1):
            return storeys, nodes


def _with_ways(nodes: DataFrame, ways: DataFrame, run, schema: str) -> DataFrame:
    keys = ["tree", "chunk"]
    return nodes.groupBy(*keys).cogroup(ways.groupBy(*keys)).applyInArrow(run, schema)


def _down(storeys: list[DataFrame], ways: DataFrame, cfg: MerkleConfig, top: bool) -> DataFrame:
    """Ways of the nodes of the lowest of the storeys, from those of the roots."""
    for storey in reversed(storeys):
        plain = storey.select("tree", "chunk", "pos", "total", "digest")
        ways = stored(_with_ways(plain, ways, _ways(cfg, top and storey is storeys[0]), _WAYS), "merkle-ways")
    return ways


def manifest(rows: DataFrame, changed: Column, cfg: MerkleConfig = MerkleConfig()) -> DataFrame:
    """One row per input row: id (the order column), leaf, subroot (its
    group's), root, proof_sha256 (hash of all siblings from leaf to root, level
    by level, left to right), folded_root (the root when the row's leaf is the
    one in ``changed``, a column expression), verified (it equals the root).

    Needs the columns ``cfg.fields``, ``cfg.group`` and ``cfg.order``; others
    are not read. Nulls in any field are part of the leaf (``-``), and differ
    from empty texts. Rows of a null group have a tree of their own, the first;
    rows with a null order value come first in their tree. Rows that tie in
    order follow their leaves' digests; equal rows are interchangeable. A lone
    row is its own root and its proof has no siblings. Null in ``changed``
    leaves a leaf as it is. An empty table gives an empty table.
    """
    leaf = leaf_hash([F.col(f) for f in cfg.fields])
    # a key without nulls, in the order of the groups: null, then bytewise
    group = F.coalesce(F.concat(F.lit("="), F.col(cfg.group).cast("string")), F.lit("-"))
    hashed = stored(rows.select(group.alias("grp"), F.col(cfg.order).alias("id"), leaf.alias("digest"),
                                F.coalesce(changed, leaf).alias("changed")), "merkle-leaves")
    ordered = stored(dense_index(hashed, ["grp", "id", "digest"], idx_col="idx"), "merkle-ordered")
    groups = stored(ordered.groupBy("grp").agg(F.min("idx").alias("start"), F.count("*").alias("total")), "merkle-groups")
    groups = dense_index(groups, ["grp"], idx_col="tree")
    leaves = stored(look_up(ordered, groups, "grp").select(
        "tree", (F.col("idx") - F.col("start")).alias("pos"), "total", "digest", "id", "changed"), "merkle-positions")

    storeys, subroots = _storeys(leaves, cfg)
    n_groups = subroots.count()
    top_storeys, roots = _storeys(subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_groups).cast("long").alias("total"),
        "digest"), cfg)
    start = roots.select("tree", F.col("pos").alias("chunk"), F.array().cast(_WAY_DDL).alias("way"),
                         F.lit(None).cast("string").alias("subroot"))
    ways = _down(top_storeys, start, cfg, top=True)
    ways = ways.select(F.col("chunk").alias("tree"), F.lit(0).cast("long").alias("chunk"), "way", "subroot")
    ways = _down(storeys[1:], ways, cfg, top=False)

    root = roots.first()
    root = F.lit(root.digest if root else None).cast("string")
    id_type = leaves.schema["id"].dataType.simpleString()
    return _with_ways(storeys[0], ways, _folded(cfg), f"id {id_type}, leaf string, subroot string, proof_sha256 string, "
                      "folded_root string").select(
        F.col("id").alias(cfg.order), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == root).alias("verified"))


def tampered_leaf(cfg: MerkleConfig = MerkleConfig(), third: int = 3) -> Column:
    """The leaf after the text's A-Z have been lower-cased in the rows where
    ``third`` divides the CRC-32 of the decimal doc_id; null in other rows."""
    fields = [F.translate(F.col(f), UPPER, LOWER) if f == "text" else F.col(f) for f in cfg.fields]
    return F.when(F.crc32(F.col("doc_id").cast("string")) % third == 0, leaf_hash(fields))
