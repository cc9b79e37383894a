"""Connected components of a graph given as an edge table.

Alternating large-star and small-star rounds on DataFrames: every round is a
partial aggregate and a join on the node, so a hub with a third of all edges
is combined on the map side and its join partition may be split. Each round
is checkpointed in the shared folder.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabcast.operators.order import materialise


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v; longs) except the roots themselves.

    The root is the smallest node of a component. Loops and repeated edges
    are allowed; nulls are not.
    """
    ordered = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state = materialise(ordered.distinct())
    seen = _fingerprint(state)
    while seen[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        near = large.distinct()
        small = (
            near.join(_least(near), "u")
            .select(F.inline(F.array(
                F.struct(F.col("u"), F.col("m").alias("v")),
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            )))
            .where("u != v")
        )
        state = materialise(small.distinct())
        now = _fingerprint(state)
        if now == seen:
            break
        seen = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
