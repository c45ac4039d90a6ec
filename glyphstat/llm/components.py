"""Connected components of an undirected graph, with DataFrame operations only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphstat.llm.storage import cut, shuffles_removed


def _with_least(edges: DataFrame) -> DataFrame:
    """``(u, v, m)``: every neighbour v of u next to m, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges(u, v)``; a component is named by its least node.

    Large-star and small-star steps alternate until nothing changes: the first hangs every larger
    neighbour of a node on the node's least neighbour, the second every smaller one. The number of
    steps grows with the logarithm of the longest path; each is an aggregation with a map-side part
    and a join whose hot side is many small rows, which adaptive execution splits. Edges with a null
    end and loops are ignored.
    """
    edges = cut(edges.select("u", "v").filter("u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.distinct()
        small = _with_least(down)
        stars = (
            small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        after = cut(stars)
        with shuffles_removed(after.sparkSession):
            changed = after.join(edges, ["u", "v"], "left_anti").limit(1).count()
        if not changed and after.count() == edges.count():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                after.select("v", "v").distinct()
            )
        edges = after
