"""Connected components of a large graph by alternating large-star and small-star rounds.

Each round is two joins and two aggregations over the edges (Kiveris et al., "Connected components in
MapReduce and beyond", 2014); a node's neighbours are never gathered in one place. Rounds end when the
edges no longer change, which takes some log2 of the longest path. Each round's edges are written to
the shared work folder, so the plan doesn't grow and lost executors only repeat one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourline.llm.frames import drop_stored, stored


def _to_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the least of u and all its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least.select("u", F.least("u", "m").alias("m")), "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (BIGINT a, b): the least node reachable.

    Repeated edges and edges from a node to itself may occur; a null node has no edges. A node that
    is only joined to itself is left out, as is one that isn't in ``edges``."""
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = stored(now, "edges"), None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = tuple(sums)
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _to_least(large)  # large holds pairs with u > v only
        pairs = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        done, now = now, stored(pairs.filter("u != v").distinct(), "edges")
        drop_stored(done)
