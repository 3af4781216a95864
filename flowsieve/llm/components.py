"""Connected components of an edge table by alternating stars.

Each round points every node at the smallest neighbour it knows (large star,
then small star); the edge count never grows, and a component of n nodes
settles in O(log n) rounds in practice. Group minima are aggregated map-side
before the shuffle; a large star gives those of hubs with very many edges back
from a broadcast, so such a hub is never gathered in one place.

Before a round one aggregation of the edges by node tells whether any is needed
and which nodes are hubs: edges are settled when they are stars around the
smallest nodes. So settled edges cost no round, and a table of stars plus some
new edges takes few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from flowsieve.session import written as stored

#: Nodes with fewer edges are no hubs, however few edges there are in all.
HUB = 256


def _nodes(edges: DataFrame) -> DataFrame:
    """(node, low, n, below): the smallest of a node and its neighbours, its
    edges, and how many of them lead to smaller nodes."""
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    return both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("low"), F.count("*").alias("n"),
                                    F.count_if(F.col("other") < F.col("node")).alias("below"))


def _unsettled(nodes: DataFrame, total: int, share: int = 1000) -> tuple[int, list]:
    """How many nodes are neither the centre of a star of larger nodes nor the
    end of one edge to a smaller node; (node, low) of the hubs, the nodes with
    more than one in ``share`` of all ends of ``total`` edges, so fewer than
    ``share`` of them."""
    hub = (F.col("n") * share > 2 * total) & (F.col("n") >= HUB)
    return tuple(nodes.agg(F.count_if((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("n") > 1))),
                           F.collect_list(F.when(hub, F.struct("node", "low")))).first())


def _large_star(edges: DataFrame, nodes: DataFrame, hubs: list) -> DataFrame:
    """Links the larger neighbours of each node to its minimum: a row for each edge."""
    up, nodes = edges.select(F.col("v").alias("node"), F.col("u").alias("larger")), nodes.select("node", "low")
    if hubs:
        is_hub = F.col("node").isin([h[0] for h in hubs])
        low = edges.sparkSession.createDataFrame([tuple(h) for h in hubs], nodes.schema)
        found = up.where(~is_hub).join(nodes.where(~is_hub), "node").unionByName(
            up.where(is_hub).join(F.broadcast(low), "node"))
    else:
        found = up.join(nodes, "node")
    return found.select(F.col("larger").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of each node and the node itself to the least of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(low, "u").select(F.explode(F.array(
        F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
        F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node id
    of the component and is itself not listed.

    Null ends and loops are ignored; an empty table gives an empty table.
    """
    cur = stored(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                 .distinct(), "cc")
    while total := cur.count():
        nodes = _nodes(cur)
        unsettled, hubs = _unsettled(nodes, total)
        if not unsettled:
            break
        cur = stored(_small_star(stored(_large_star(cur, nodes, hubs), "cc-large")), "cc")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
