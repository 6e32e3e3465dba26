"""Connected components of a graph given as links, by alternating large and small stars.

Each round hooks every node's larger neighbours, then its smaller ones, to the smallest node
it can see. A node's neighbours are never gathered: the smallest comes from an aggregation
with a partial step, and goes back to the links by a join whose skew Spark can split. Rounds
grow with the logarithm of the component sizes; each is written to the shared folder, so the
lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged

MOST_ROUNDS = 60


def hooked(links: DataFrame) -> DataFrame:
    """One round: links (a, b) with a > b in, such links out."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    joined = large.join(least, "a")
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in links (a, b) of bigint; root is the component's smallest node.

    Links may repeat, point either way or join a node to itself; no links give no rows.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = staged(links, "links"), None
    for _ in range(MOST_ROUNDS):
        # Equal count and checksum: the round changed nothing, so every link is (node, root).
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        links = staged(hooked(links), "links")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
