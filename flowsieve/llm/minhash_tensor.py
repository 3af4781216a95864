"""MinHash near-duplicate groups with tensored banding.

A document's set is its distinct ``shingle``-word shingles (A-Z folded). The
hash tables of a banding scheme are not built from fresh minhashes: ``bands``
small collections of ``rows`` minhashes each are computed once, and every
pair of collections (i, j) is one table whose key combines the two. 20
collections of 3 give 190 tables of 6 minhashes from 60 minhash computations
instead of 1,140. A pair is found when at least two collections agree: at
similarity 0.80 it is missed with probability 1.3e-5, at 0.85 with 2e-7.

Every candidate is confirmed on the full shingle sets. Steps:

1. one pass over the texts gives each document its set size, a 128-bit digest
   of the set and the minhashes; documents with the same set are one node;
2. one shuffle of (key, node) orders each bucket by node. Buckets of up to
   four nodes yield all their pairs, larger ones the pairs with their smallest
   node; the confirmed links are joined into components;
3. larger buckets whose nodes are still in different components are joined into
   families, and pairs of a family that cross components are compared on the full
   sets, a bounded block of nodes against another at a time;
4. components over all confirmed links.

A family of more than a block is not compared pair by pair. Its centre is the
set of shingles that more than half of its nodes have, and a node is known by
what sets it apart from the centre. Two sets differ by what sets each apart,
less twice what they share of that; so a link needs a number of shared
deviations that follows from the two sets' own counts, exactly. Nodes so near
the centre that they need none are linked at once. Of the others only those are
compared that share one of their rarest deviations (as many as leave fewer than
the number needed). Texts that have a template in common and the rest to
themselves share no deviation, and are never compared however many they are.

Before sets are fetched, a pair must agree in 33 of its 60 minhashes, which a
pair at 0.80 misses with probability 3e-6.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from flowsieve.llm.arrow_text import blocks, hash_words, mix64, row_runs, small_batches, word_spans
from flowsieve.llm.components import connected_components
from flowsieve.llm.hot_keys import hot_of, look_up
from flowsieve.session import written as stored

SMALL_BUCKET = 4


@dataclass(frozen=True)
class NearDupConfig:
    """``percent``: least similarity in hundredths. ``block``: nodes of a family
    that one task compares with as many others at a time."""

    shingle: int = 5
    percent: int = 80
    bands: int = 20
    rows: int = 3
    seed: int = 20240229
    block: int = 512

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_agreeing(self) -> int:
        """Minhashes that a pair at the least similarity agrees in, less 4.8
        standard deviations (33 of 60 at 0.80)."""
        p = self.percent / 100
        return max(0, int(self.hashes * p - 4.8 * (self.hashes * p * (1 - p)) ** 0.5))


def _multipliers(cfg: NearDupConfig) -> tuple[np.ndarray, np.ndarray]:
    salts = mix64(np.arange(1, 2 * cfg.hashes + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                  + np.uint64(cfg.seed))
    salts = (salts >> np.uint64(32)).astype(np.uint32)
    return salts[:cfg.hashes] | np.uint32(1), salts[cfg.hashes:]


def shingle_hashes(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash), distinct and ordered by row and hash. A row of one to
    k - 1 words has its whole sequence as one shingle."""
    starts, ends, row = word_spans(data, offs)
    h = hash_words(data, starts, ends, lower=True)
    n = len(h)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    odd = mix64(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    acc = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
    for j in range(k if len(acc) else 0):
        acc += h[j:j + len(acc)] * odd[j]
    at = np.flatnonzero(row[:len(acc)] == row[k - 1:k - 1 + len(acc)])
    rows, hashes = row[at], mix64(acc[at])
    own, first = row_runs(row)
    size = np.diff(np.append(first, n))
    short = size < k
    if short.any():
        extra = np.zeros(int(short.sum()), dtype=np.uint64)
        for j in range(k - 1):
            has = size[short] > j
            extra[has] += h[first[short][has] + j] * odd[j]
        extra = mix64(extra + size[short].astype(np.uint64))
        rows, hashes = np.concatenate((rows, own[short])), np.concatenate((hashes, extra))
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[keep], hashes[keep]


def _binary(values: np.ndarray, width: int, n: int) -> pa.Array:
    offs = (np.arange(n + 1, dtype=np.int32) * width).tobytes()
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offs), pa.py_buffer(values.tobytes())])


def _signatures(cfg: NearDupConfig):
    def run(batches):
        mul, add = _multipliers(cfg)
        for rows, data, offs in blocks(batches, "text"):
            n = rows.num_rows
            row, hashes = shingle_hashes(data, offs, cfg.shingle)
            own, first = row_runs(row)
            size = np.zeros(n, dtype=np.int64)
            size[own] = np.diff(np.append(first, len(row)))
            digest = np.zeros((2, n), dtype=np.uint64)
            sig = np.zeros((n, cfg.hashes), dtype=np.uint32)
            if len(row):
                digest[0, own] = np.add.reduceat(mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first)
                digest[1, own] = np.add.reduceat(mix64(hashes * np.uint64(0xC2B2AE3D27D4EB4F)), first)
                low = (hashes >> np.uint64(32)).astype(np.uint32)
                for i in range(cfg.hashes):
                    v = low * mul[i] + add[i]
                    v ^= v >> np.uint32(15)
                    v *= np.uint32(0x2C1B3C6D)
                    v ^= v >> np.uint32(12)
                    sig[own, i] = np.minimum.reduceat(v, first)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(size), pa.array(digest[0].view(np.int64)),
                 pa.array(digest[1].view(np.int64)), _binary(sig, 4 * cfg.hashes, n)],
                names=["doc_id", "n_shingles", "d0", "d1", "sig"])
    return run


def _table_keys(cfg: NearDupConfig):
    def run(batches):
        a, b = np.triu_indices(cfg.bands, 1)
        tables = mix64(np.arange(1, len(a) + 1, dtype=np.uint64))
        for batch in batches:
            ids = batch.column("node").to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32)
            sig = sig.reshape(len(ids), cfg.bands, cfg.rows).astype(np.uint64)
            band = np.zeros((len(ids), cfg.bands), dtype=np.uint64)
            for r in range(cfg.rows):
                band = mix64(band + sig[:, :, r] + np.uint64(r + 1))
            for s in range(0, len(ids), 512):
                part = band[s:s + 512]
                keys = mix64(part[:, a] + mix64(part[:, b] + tables))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids[s:s + 512], len(a)))],
                    names=["key", "node"])
    return run


def _agree(cfg: NearDupConfig):
    """Pairs whose sizes allow the similarity and whose minhashes agree in half."""
    def run(batches):
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, cfg.hashes)
                      for c in ("sig_a", "sig_b"))
            keep = (sa == sb).sum(axis=1) >= cfg.least_agreeing
            yield batch.select(["a", "b"]).filter(pa.array(keep))
    return run


def _crossing(cfg: NearDupConfig):
    """Links between one block of a family and another (or itself) that join
    different components. Pairs within the family's largest component are
    skipped unseen, and so are pairs that links of this task already join."""
    def run(table: pa.Table) -> pa.Table:
        sets = table.column("set").to_pylist()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), dtype=np.uint32).reshape(-1, cfg.hashes)
        node, root, blk = (table.column(c).to_numpy() for c in ("node", "root", "blk"))
        big, x, y = (table.column(c)[0].as_py() for c in ("big", "x", "y"))
        size = np.array([len(s) // 8 for s in sets])
        _, ids = np.unique(np.frombuffer(b"".join(sets), dtype=np.uint64), return_inverse=True)
        cut = np.concatenate(([0], np.cumsum(size)))
        marked = np.zeros(int(ids.max()) + 1, dtype=bool)
        parent: dict[int, int] = {}

        def find(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x
        left, right = np.flatnonzero(blk == x), np.flatnonzero(blk == y)
        out = []
        for part, other in ((left[root[left] != big], right), (left[root[left] == big], right[root[right] != big])):
            for i in part:
                j = other[(root[other] != root[i])
                          & (100 * np.minimum(size[other], size[i]) >= cfg.percent * np.maximum(size[other], size[i]))]
                j = j[(sig[j] == sig[i]).sum(axis=1) >= cfg.least_agreeing] if len(j) else j
                if not len(j):
                    continue
                marked[ids[cut[i]:cut[i + 1]]] = True
                for k in j:
                    a, b = find(root[i]), find(root[k])
                    if a != b:
                        both = int(marked[ids[cut[k]:cut[k + 1]]].sum())
                        if 100 * both >= cfg.percent * (size[i] + size[k] - both):
                            parent[max(a, b)] = min(a, b)
                            out.append((min(node[i], node[k]), max(node[i], node[k])))
                marked[ids[cut[i]:cut[i + 1]]] = False
        return pa.table({c: pa.array([int(p[i]) for p in out], pa.int64()) for i, c in enumerate("ab")})
    return run


def _sets(cfg: NearDupConfig):
    def run(batches):
        for rows, data, offs in blocks(batches, "text"):
            row, hashes = shingle_hashes(data, offs, cfg.shingle)
            cut = np.searchsorted(row, np.arange(rows.num_rows + 1))
            sets = [hashes[cut[i]:cut[i + 1]].tobytes() for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array(sets, pa.binary())], names=["node", "set"])
    return run


def _confirm(cfg: NearDupConfig):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= cfg.percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _elements(column: str):
    """(family, node, el) of each shingle in a binary column."""
    def run(batches):
        for batch in batches:
            values = batch.column(column).to_pylist()
            size = np.array([len(v) // 8 for v in values], dtype=np.int64)
            upto = np.concatenate(([0], np.cumsum(size)))
            a = 0
            while a < len(values):  # a quarter of a million elements at a time, or one set
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + (1 << 18), side="right")) - 1)
                at = pa.array(np.repeat(np.arange(a, b), size[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("family").take(at), batch.column("node").take(at),
                     pa.array(np.frombuffer(b"".join(values[a:b]), dtype=np.int64))], names=["family", "node", "el"])
                a = b
    return run


def _deviations(cfg: NearDupConfig):
    """For each node of a part of a family the elements that it has and the
    centre has not, or the other way round, and its excess: two nodes are linked
    if and only if 2 * (100 + percent) times the deviations they share reaches
    the sum of their excesses."""
    def run(nodes: pa.Table, centre: pa.Table) -> pa.Table:
        middle = np.sort(centre.column("el").to_numpy().astype(np.int64))
        apart, excess = [], []
        for v in nodes.column("set").to_pylist():
            own = np.frombuffer(v, dtype=np.int64)
            diff = np.setxor1d(own, middle, assume_unique=True)
            apart.append(diff.tobytes())
            excess.append((100 + cfg.percent) * len(diff) - (100 - cfg.percent) * len(own))
        return pa.table({"family": nodes.column("family"), "node": nodes.column("node"), "root": nodes.column("root"),
                         "item": nodes.column("item"), "apart": pa.array(apart, pa.binary()), "excess": pa.array(excess, pa.int64())})
    return run


def _with_both(pairs: DataFrame, side: DataFrame, columns: list[str]) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(side.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return pairs


def near_duplicates(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the smallest
    doc_id reachable over links, itself included), kept.

    Needs columns doc_id (integer) and text; other columns are not read. A
    null or wordless text has an empty set and links with nothing. A null
    doc_id has component_id null and is kept. Rows that repeat a doc_id count
    as that document in every link. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = stored(base.mapInArrow(_signatures(cfg), "doc_id long, n_shingles long, d0 long, d1 long, sig binary"),
                   "minhash-sig")
    usable = facts.where("doc_id is not null and n_shingles > 0")
    nodes = stored(usable.groupBy("d0", "d1", "n_shingles")
                   .agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), F.first("sig").alias("sig")), "minhash-nodes")

    keys = nodes.select("node", "sig").mapInArrow(_table_keys(cfg), "key long, node long")
    bucket = Window.partitionBy("key")
    ordered = bucket.orderBy("node")
    members = (keys.withColumn("size", F.count("*").over(bucket))
               .withColumn("hub", F.first("node").over(ordered))
               .withColumn("p1", F.lag("node", 1).over(ordered))
               .withColumn("p2", F.lag("node", 2).over(ordered))
               .where("size > 1"))
    members = stored(members, "minhash-buckets")
    in_small = F.col("size") <= SMALL_BUCKET
    pairs = (members.select(F.col("node").alias("b"), F.explode(F.array_distinct(F.array(
                "hub", F.when(in_small, F.col("p1")), F.when(in_small, F.col("p2"))))).alias("a"))
             .where("a < b").distinct())

    agreeing = _with_both(pairs, nodes, ["n_shingles", "sig"]).where(
        f"100 * least(n_shingles_a, n_shingles_b) >= {cfg.percent} * greatest(n_shingles_a, n_shingles_b)")
    pairs = stored(agreeing.select("a", "b", "sig_a", "sig_b").mapInArrow(_agree(cfg), "a long, b long"),
                   "minhash-pairs")

    # sets of the nodes that any comparison can need, made once; texts that share a
    # doc_id all keep theirs
    wanted = (members.where(f"size > {SMALL_BUCKET}").select("node")
              .unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct())
    sets = stored(wanted.join(base, wanted["node"] == base["doc_id"])
                  .select("node", "text").mapInArrow(_sets(cfg), "node long, set binary")
                  .where("octet_length(set) > 0").dropDuplicates(["node", "set"]), "minhash-sets")

    def confirmed(candidates: DataFrame) -> DataFrame:
        return _with_both(candidates, sets, ["set"]).select("a", "b", "set_a", "set_b").mapInArrow(
            _confirm(cfg), "a long, b long")

    same = F.struct("d0", "d1", "n_shingles").alias("same")
    lowest = nodes.select(same, "node", "n")
    to_node = look_up(usable.select("doc_id", same), lowest.drop("n"), "same",
                      hot=hot_of(lowest, "same", "n", usable.count()), nulls=False).select("doc_id", "node")
    found = confirmed(pairs)
    repeated = usable.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.head(1):
        own = to_node.join(repeated, "doc_id").distinct()
        low = own.groupBy("doc_id").agg(F.min("node").alias("a"))
        found = found.unionByName(own.join(low, "doc_id").where("a < node").select("a", F.col("node").alias("b")))
    links = stored(found, "minhash-links")
    roots = connected_components(links, "a", "b")
    more = stored(_crossing_links(members, nodes, sets, roots, cfg), "minhash-links")
    if more.head(1):
        # the components found so far are stars; the new links join them
        roots = connected_components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "a", "b")

    label = (to_node.join(roots, "node", "left")
             .select("doc_id", F.coalesce("root", "node").alias("root"))
             .groupBy("doc_id").agg(F.min("root").alias("root")))
    return (facts.select("doc_id", "n_shingles").join(label, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """The rows, all their columns, that stand for their group: those of its
    smallest doc_id.

    Null, empty and wordless texts are kept. Rows without a doc_id are compared
    too, each as a document that comes behind all others. Rows that repeat a
    doc_id stay or go together. Columns besides doc_id and text may have any
    name. An empty table gives an empty table.
    """
    if not docs.where("doc_id is null").head(1):
        dropped = near_duplicates(docs, cfg).where("not kept").select("doc_id").distinct()
        return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    # ids for the rows that have none, behind the largest one
    last = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
    row = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("at")), "minhash-rows")
    row = row.withColumn("doc_id", F.coalesce(F.col("row.doc_id").cast("long"), F.col("at") + F.lit((last or 0) + 1)))
    dropped = near_duplicates(row.select("doc_id", F.col("row.text").alias("text")), cfg).where("not kept").select("doc_id").distinct()
    return row.join(dropped, "doc_id", "left_anti").select("row.*")


def _crossing_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, roots: DataFrame,
                    cfg: NearDupConfig) -> DataFrame:
    """Links that join components, among the nodes that meet in large buckets.

    Buckets with the same smallest node are one; those with nodes of different
    components join into families, so that a pair that meets in many tables is
    compared once.
    """
    met = members.where(f"size > {SMALL_BUCKET}").select("hub", "node").distinct()
    met = stored(met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "minhash-met")
    split = stored(met.groupBy("hub").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m"))
                   .where("lo < hi").select("hub", "m"), "minhash-split")
    open_ = stored(look_up(met, split, "hub", hot=hot_of(split, "hub", "m", met.count()), nulls=False).where("m is not null").select("hub", "node", "root"), "minhash-open")
    family = connected_components(open_, "hub", "node").withColumnRenamed("root", "family")
    placed = (open_.select("node", "root").distinct().join(family, "node", "left")
              .withColumn("family", F.coalesce("family", "node")))
    sizes = stored(placed.groupBy("family").agg(F.count("*").alias("n")), "minhash-families")
    all_placed = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = stored(look_up(placed, sizes, "family", hot=hot_of(sizes, "family", "n", all_placed), nulls=False).join(sets, "node").select("family", "n", "node", "root", "set"),
                    "minhash-placed")
    cells = placed.where(F.col("n") <= cfg.block).select(F.col("family").alias("cell"), "node", "root")
    links = None
    if placed.where(F.col("n") > cfg.block).head(1):
        shared, links = _deviating(placed.where(F.col("n") > cfg.block), cfg)
        cells = cells.unionByName(shared)
    cells = stored(cells, "minhash-cells")

    big = stored(cells.groupBy("cell", "root").count()
           .groupBy("cell").agg(F.max_by("root", F.struct("count", "root")).alias("big"), F.sum("count").alias("m"),
                                F.count("*").alias("roots")).where("roots > 1").drop("roots"), "minhash-big")
    parts = F.ceil(F.col("m") / cfg.block).cast("long")
    blocked = (look_up(cells, big, "cell", hot=hot_of(big, "cell", "m", cells.count()), nulls=False).where("big is not null")
               .withColumn("blk", F.pmod(F.xxhash64("node", "cell"), parts))
               .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))))
    rows = (blocked.select("cell", "node", "root", "blk", "big", F.least("blk", "other").alias("x"),
                           F.greatest("blk", "other").alias("y")).distinct()
            .join(nodes.select("node", "sig"), "node").join(sets, "node"))
    # as many tasks as the session shuffles into: the rows are few, the comparisons are not
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (rows.repartition(tasks, "cell", "x", "y").groupBy("cell", "x", "y")
             .applyInArrow(_crossing(cfg), "a long, b long"))
    return found if links is None else found.unionByName(links)


def _deviating(placed: DataFrame, cfg: NearDupConfig) -> tuple[DataFrame, DataFrame]:
    """For families (family, n, node, root, set) of more than a block: the nodes
    to compare (cell, node, root), a cell being a deviation they share, and the
    links (a, b) of the nodes that are so near the centre that they need share
    none."""
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / cfg.block).cast("long"))
    # a doc_id with several texts has several sets
    rows = placed.withColumn("part", part).withColumn("item", F.xxhash64("node", "set"))
    centre = (placed.select("family", "node", "set").mapInArrow(_elements("set"), "family long, node long, el long")
              .groupBy("family", "el").agg(F.count("*").alias("has")))
    families = stored(placed.select("family", "n").distinct(), "minhash-large")
    centre = stored(centre.join(families, "family").where("has * 2 > n").select("family", "el", "n"), "minhash-centre")
    parts = centre.select("family", "el", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / cfg.block).cast("long") - 1))
                          .alias("part"))
    keys = ["family", "part"]
    apart = stored(rows.select(*keys, "node", "root", "item", "set").groupBy(*keys).cogroup(parts.groupBy(*keys)).applyInArrow(
        _deviations(cfg), "family long, node long, root long, item long, apart binary, excess long"), "minhash-apart")

    least = apart.groupBy("family").agg(F.min(F.struct("excess", "node", "root")).alias("mid"))
    apart = look_up(apart, least, "family", hot=hot_of(families, "family", "n", apart.count()), nulls=False).withColumn(
        "need", F.ceil((F.col("excess") + F.col("mid.excess")) / (2 * (100 + cfg.percent))).cast("long"))
    near = F.col("need") <= 0
    apart = stored(apart.withColumn("root", F.when(near, F.col("mid.root")).otherwise(F.col("root"))), "minhash-apart")
    links = (apart.where(near).where(F.col("node") != F.col("mid.node"))
             .select(F.least("node", "mid.node").alias("a"), F.greatest("node", "mid.node").alias("b")))

    cell = F.xxhash64("family", "el")
    each = stored(apart.select("family", F.col("item").alias("node"), "apart")
                  .mapInArrow(_elements("apart"), "family long, node long, el long")
                  .select(F.col("node").alias("item"), cell.alias("cell")), "minhash-deviations")
    often = stored(each.groupBy("cell").agg(F.count("*").alias("often")).where("often > 1"), "minhash-often")
    each = look_up(each, often, "cell", hot=hot_of(often, "cell", "often", each.count()), nulls=False).where("often is not null")
    own = Window.partitionBy("item")
    each = (each.join(apart.select("item", "node", "root", "need"), "item")
            .withColumn("all", F.count("*").over(own))
            .withColumn("rank", F.row_number().over(own.orderBy("often", "cell")))
            .where("rank <= `all` - greatest(need, 1) + 1"))
    return each.select("cell", "node", "root"), links
