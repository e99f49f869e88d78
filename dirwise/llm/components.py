"""Connected components of a graph whose edges never leave the executors.

Every round each vertex points at the neighbour (or itself) that comes first in an
order drawn anew for that round; edges are then drawn between the vertices pointed
at, and those that have become loops or repeats go. Drawn orders let the graph
shrink by a fixed share per round, also on long chains. Rounds are cut off by
written tables, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirwise.session import saved


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b): vertex, component (its smallest vertex) of every vertex that has an edge to another.

    Loops, repeats, either direction and nulls are allowed; an edge with a null is ignored. No edges, no rows.
    """
    pairs = edges.where("a <> b").select("a", "b")
    live = saved(pairs.union(pairs.select("b", "a")).distinct())
    label = live.select(F.col("a").alias("vertex"), F.col("a").alias("at")).distinct()
    turn = 0
    while live.limit(1).count():
        order = F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("b"))
        near = live.groupBy("a").agg(F.min(order).alias("n"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("b"))
        target = saved(near.select(F.col("a").alias("v"), F.least("n", own)["b"].alias("to")))
        label = label.join(target, label["at"] == target["v"], "left").select("vertex", F.coalesce("to", "at").alias("at"))
        left = live.join(target, live["a"] == target["v"]).select(F.col("to").alias("a"), "b")
        live = saved(left.join(target, left["b"] == target["v"]).select("a", F.col("to").alias("b")).where("a <> b").distinct())
        turn += 1
    label = saved(label)
    least = label.groupBy("at").agg(F.min("vertex").alias("component"))
    return label.join(least, "at").select("vertex", "component")
