"""Connected components of a link table, by hooking to the smallest neighbour.

Every step is an aggregate or a join of (node, label) rows; nothing is collected
but one count per round. Lineage is cut by checkpoints in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(`node`, `component`) for the nodes of `links` (`a`, `b`); the component is its smallest node.

    Large-star and small-star rounds in turn (Kiveris et al. 2014): each node
    links its neighbours to its smallest one, so that a component ends as a
    star. The number of rounds grows with the logarithm of the longest path.
    Links with a null end and links from a node to itself are ignored; an
    empty table gives an empty result.
    """
    pairs = links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    pairs = cut(pairs.distinct())
    before = None
    while True:
        # Large star: neighbours above a node go to the smallest one around it.
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("low")))
        up = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        up = cut(up.where("a <> b").distinct())
        # Small star: neighbours below a node, and the node, go to the smallest.
        low = cut(up.groupBy("a").agg(F.min("b").alias("low")))
        down = up.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        down = down.union(low.select("a", F.col("low").alias("b")))
        pairs = cut(down.where("a <> b").distinct())
        # A forest of stars that no round changes any more has the same sums.
        state = pairs.agg(
            F.count("*"),
            F.bit_xor(F.xxhash64("a", "b")),
        ).first()
        if state == before:
            break
        before = state
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
