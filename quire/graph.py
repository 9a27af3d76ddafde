"""Connected components by randomised contraction, for graphs of any shape and size.

Each round gives every vertex the smallest of itself and its neighbours in a fresh random order
and contracts the edges onto these representatives; the expected number of vertices falls by a
constant factor a round, whatever the diameter (Boegeholz, Brand, Todor 2020). A hub of any degree
costs one row of a partially aggregated minimum; the joins that relabel edges are equi-joins with
one row per vertex on the other side, which adaptive execution splits where a vertex is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import cut


def star_edges(members: DataFrame, hub: str, member: str) -> DataFrame:
    """Edges ``(u, v)`` that link every ``member`` of a ``hub`` to the hub's smallest member.

    Null hubs and members link nothing. As many rows as members at most, never all pairs.
    """
    rows = members.select(F.col(hub).alias("_hub"), F.col(member).alias("u")).dropna().distinct()
    least = rows.groupBy("_hub").agg(F.min("u").alias("v"))
    return rows.join(least, "_hub").where("u <> v").select("u", "v").distinct()


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(vertex, component)`` for every vertex of ``edges(u, v)``; ``component`` is one of its vertices.

    Null ends and loops are ignored; an empty graph gives no rows. Vertices may be of any
    orderable type. Every round is written to the checkpoint folder, so a lost executor costs one
    round at most and nothing is gathered on the driver.
    """
    edges = edges.select("u", "v").dropna().where("u <> v")
    edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    steps: list[DataFrame] = []
    for number in range(max_rounds):
        if edges.isEmpty():
            break
        rank = lambda c, n=number: F.struct(F.xxhash64(F.lit(n), c).alias("h"), c.alias("x"))
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        parent = (
            both.groupBy("u")
            .agg(F.min(rank(F.col("v"))).alias("m"))
            .select(F.col("u").alias("vertex"), F.least("m", rank(F.col("u")))["x"].alias("parent"))
        )
        parent = cut(parent)
        steps.append(parent)
        left = parent.select(F.col("vertex").alias("u"), F.col("parent").alias("pu"))
        right = parent.select(F.col("vertex").alias("v"), F.col("parent").alias("pv"))
        moved = edges.join(left, "u").join(right, "v").where("pu <> pv")
        edges = cut(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if not steps:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    labels = steps[-1].select("vertex", F.col("parent").alias("component"))
    for parent in reversed(steps[:-1]):
        later = labels.select(F.col("vertex").alias("parent"), F.col("component").alias("later"))
        labels = parent.join(later, "parent", "left").select("vertex", F.coalesce("later", "parent").alias("component"))
    return labels
