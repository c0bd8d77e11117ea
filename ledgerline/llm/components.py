"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common


#: Edges of a vertex from which on it is a hub, too much for one task, whose least neighbour is broadcast; and hubs at most.
HUB_EDGES, MAX_HUBS = 1_000_000, 100_000


def _with_least(edges: DataFrame, n_edges: int) -> DataFrame:
    """`edges` (u, v) with `m`, the least v of each u.

    So few edges that no vertex can be a hub are dealt by u once. Else the least are aggregated before the
    shuffle and joined, and edges of hubs stay where they are: a hub's row goes to them.
    So many edges a hub needs that no more than MAX_HUBS vertices can have them.
    """
    if 2 * n_edges < HUB_EDGES:
        return edges.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = F.broadcast(least.filter(F.col("n") > max(HUB_EDGES, 2 * n_edges // MAX_HUBS)).select("u", "m"))
    return edges.join(hubs, "u").unionByName(edges.join(hubs, "u", "left_anti").join(least.select("u", "m"), "u"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id that has an edge.

    Rounds of large-star and small-star on the edges: each vertex's larger
    neighbours, then its smaller ones, move to its smallest neighbour. A path
    shrinks geometrically. Every round is checkpointed. Rounds end when
    one changes no edge, which only stars survive. Loops and repeated edges count
    once, edges with a null end not at all.
    """
    edges = common.checkpointed(edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    told = F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("v", "u") % 1_000_003)
    signature, n = None, edges.count()
    while n:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, n).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v")
        small = _with_least(large, n).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = common.checkpointed(small.filter("u <> v").distinct())
        row = tuple(edges.agg(*told).first())
        if row == signature:
            break
        signature, n = row, row[0]
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
