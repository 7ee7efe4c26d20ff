"""Connected components of an edge table, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them. Edges lead from u down to v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it is connected with) for all nodes of the edges (u, v), u > v.

    Each round writes its edges, so no plan grows with the number of rounds, which is logarithmic in the longest
    path. A node with very many neighbours is a hot join key on a plain shuffle that adaptive execution splits; the
    minimum per node is taken before its shuffle. Only counts and sums of the edges reach the driver.
    """
    edges = stored(edges.select("u", "v").distinct(), "edges")
    state = None
    while True:
        summary = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if summary == state or not summary[0]:
            break
        state = summary
        edges = stored(_small_star(_large_star(edges)), "edges")
    # Now every edge leads from a node to the smallest of its component.
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
