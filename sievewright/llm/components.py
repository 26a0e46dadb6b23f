"""Connected components by seed-tree pruning (problem 2).

Every vertex connects its neighbourhood to the neighbourhood's minimum.  A vertex that is nobody's minimum,
its own included, drops out and hangs in a propagation forest below the smallest minimum it was given; the
remaining vertices keep the minima connected and go on.  When no edge is left the remaining vertices are
seeds, the minima of their components, and their identifiers flow down the forest, the last dropped first.
Neighbourhoods are only ever aggregated to a minimum, never collected, so a hub costs partial aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut


def components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """vertex, group of every vertex of the edges (a, b); group is the smallest vertex of its component.

    Edges count in either direction and may repeat; an edge with a null end links nothing; a self edge makes
    its vertex known.  Vertices may be of any type that orders; an empty table gives an empty result.
    Every round drops at least the vertices that are no local minimum, so rounds grow as the logarithm of
    the longest chain; each round is cut off by a checkpoint.
    """
    ends = edges.toDF("a", "b").where("a is not null and b is not null")
    every = cut(ends.select(F.explode(F.array("a", "b")).alias("vertex")).distinct())
    around = ends.where("a <> b").select("a", "b").union(ends.where("a <> b").select("b", "a")).toDF("u", "v").distinct()
    around = cut(around)
    dropped: list[DataFrame] = []
    while around.limit(1).count():
        if len(dropped) == most_rounds:
            raise ValueError(f"more than {most_rounds} rounds")
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        given = around.join(least, "u").select(F.col("v").alias("u"), "m").union(least.select("u", "m")).distinct()
        given = cut(given)
        best = given.groupBy("u").agg(F.min("m").alias("top"), F.max(F.col("u") == F.col("m")).alias("stays"))
        best = cut(best)
        dropped.append(best.where("not stays").select(F.col("u").alias("vertex"), F.col("top").alias("parent")))
        kept = given.join(best.select("u", "top"), "u").where("m <> top").select("m", "top")
        around = cut(kept.union(kept.select("top", "m")).toDF("u", "v").distinct())
    gone = None  # every vertex drops out once at most, so one join leaves the seeds
    for d in dropped:
        gone = d.select("vertex") if gone is None else gone.union(d.select("vertex"))
    seeds = every if gone is None else every.join(gone, "vertex", "left_anti")
    label = cut(seeds.select("vertex", F.col("vertex").alias("group")))
    for d in reversed(dropped):
        below = d.join(label.select(F.col("vertex").alias("parent"), "group"), "parent").select("vertex", "group")
        label = cut(label.union(below))
    return label
