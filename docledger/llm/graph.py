"""Connected components by alternating large-star and small-star steps.

Each step is a map-side combined minimum per node and a balanced join back, so that a hub with a third of all
edges is dealt over many tasks. Edges are written to the shared folder after every round; the driver sees only
their number and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docledger.llm.common import attach, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest node of the neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return attach(both, least, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    linked = attach(down, least, "a", "b").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return linked.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint) that isn't itself the smallest of its component;
    root is that smallest node."""
    before = None
    while True:
        edges = written(_small_star(_large_star(edges)), "star")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
