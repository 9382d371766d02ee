"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (pre-aggregated in each task) and a join on the node, so neither edges nor labels
ever meet on the driver, and the number of rounds is logarithmic. The minima are checkpointed before the join: both its
sides then come straight from an exchange, and the skew join can split a hot node's edges. After each round the edges
are checkpointed too, which ends their lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    low = cut_lineage(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    low = cut_lineage(e.groupBy("a").agg(F.min("b").alias("m")))
    up = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return up.union(low.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b; any order, repeats and loops allowed).

    label is the smallest node of the component. No edges: no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = cut_lineage(e), None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            break
        before = now
        e = cut_lineage(_small_star(_large_star(e).distinct()).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        e.select("b", F.col("b").alias("label")).distinct())
