"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import support


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a``, ``b``, longs): the least node of its component.

    A round is a large-star and a small-star step: every node hooks its greater neighbours, and then
    its smaller neighbours and itself, to the least node that it knows. Old roots are hooked like
    other nodes, so the rounds are logarithmic in the size of a component, long paths included. Arcs
    lead from a node to a smaller one and are written to the shared folder; once they are stars, they
    are the labels. An error is raised if ``most_rounds`` don't suffice.
    """
    arcs = support.written(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    rounds = 0
    while not stars(arcs):
        if rounds == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        rounds += 1
        both = arcs.union(arcs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = support.written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select("v", "m").union(least)
        arcs = support.written(small.toDF("u", "v").distinct(), "edges")
    return arcs.select(F.col("u").alias("node"), F.col("v").alias("label")).union(arcs.select("v", "v").distinct())


def stars(arcs: DataFrame) -> bool:
    """Whether every node has one arc to its root, and no root has an arc."""
    ends = arcs.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(arcs.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").limit(1).count()
