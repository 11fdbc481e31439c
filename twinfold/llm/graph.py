"""Connected components by alternating stars, for edges too many for one machine.

Each round points every node at the least node among its neighbours, first for
the larger neighbours and then for the smaller ones, until only stars are left;
the number of rounds grows with the logarithm of the component's diameter.
Minima are combined before they are shuffled, so a hub with very many edges
isn't gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinfold.functions.storage import checkpoint, release


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), both long; root is the least node reachable."""
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, e = e, checkpoint(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(old)
        if now == state:
            break
        state = now
    roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
