"""Connected components of a graph too large for one machine, by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). An edge is kept once, from its larger end to
its smaller. Each step is a grouped minimum and an equality join with one row a node, so a node of very many edges is
summed map-side and its join partition can be split. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import discard, materialize


def _parents(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("parent"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``root`` for every node that is not the least of its component; root is the least.

    Loops, repeated edges and edges with a null end add nothing; no edges give no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") != F.col("lo")))
    now = materialize(pairs.distinct())
    while True:
        parents = _parents(now)
        large = now.join(parents, now["lo"] == parents["node"], "left").select("hi", F.coalesce("parent", "lo").alias("lo")).distinct()
        large = materialize(large)
        least = large.join(_parents(large), F.col("hi") == F.col("node"))
        small = least.select("hi", F.col("parent").alias("lo")).union(least.where("lo != parent").select(F.col("lo").alias("hi"), F.col("parent").alias("lo")))
        before, now = now, materialize(small.distinct())
        discard(before, large)
        many = now.groupBy("hi").agg(F.count("*").alias("n")).where("n > 1")
        chained = now.select(F.col("lo").alias("hi")).join(now.select("hi"), "hi", "left_semi")
        if many.isEmpty() and chained.isEmpty():
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
