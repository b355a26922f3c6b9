"""Distributed connected components by repeated contraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear, stash, stashes


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``; component is the smallest node reachable.

    Each round lets every node point to the neighbour (or itself) of lowest random priority and contracts the graph along
    these pointers, so that the number of nodes falls by a constant factor whatever the shape; chains and stars alike take
    a logarithmic number of rounds. Rounds are written to the shared folder. Self loops, repeated edges and an empty table
    are allowed; edges with a null end are ignored.
    """
    kind, spark, mark = edges.schema["a"].dataType, edges.sparkSession, stashes()
    one = edges.select("a", "b").where("a <> b")
    current = stash(one.union(one.select("b", "a")).distinct())
    parents: list[DataFrame] = []
    while not current.isEmpty():
        rank = lambda c, k=len(parents): F.struct(F.xxhash64(c, F.lit(k)).alias("p"), c.alias("node"))
        parent = stash(
            current.groupBy("a").agg(F.min(rank(F.col("b"))).alias("m"))
            .select(F.col("a").alias("node"), F.least(rank(F.col("a")), F.col("m"))["node"].alias("parent"))
        )
        parents.append(parent)
        a = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        b = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        later = stash(current.join(a, "a").join(b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
        clear(spark, mark, *parents, later)
        current = later
    if not parents:
        clear(spark, mark)
        return spark.createDataFrame([], "node long, component long").select(F.col("node").cast(kind), F.col("component").cast(kind))
    found = parents[0]
    for p in parents[1:]:
        found = found.join(p.select(F.col("node").alias("parent"), F.col("parent").alias("up")), "parent", "left").select("node", F.coalesce("up", "parent").alias("parent"))
    found = stash(found)
    # written before it is joined, so that the join has a shuffle of its own and a giant component is split as skew
    least = stash(found.groupBy("parent").agg(F.min("node").alias("component")))
    out = stash(found.join(least, "parent").select("node", "component"))
    clear(spark, mark, out)
    return out
