"""Connected components by alternating large-star and small-star.

Large-star joins each node's larger neighbours to its least neighbour (itself included); small-star joins
its smaller neighbours and itself to the least of them. Both keep components whole, and the edges end
as stars about each component's least node. A node's least neighbour is a grouped minimum (combined
before the shuffle) and is joined back. Nodes with many edges are few by the number of edges alone (at most
MOST_HEAVY): they are joined by broadcast, so no task holds a node with more edges than HEAVY allows. Each
round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written

#: Bound of the nodes that count as heavy, and the least number of edges that makes a node so: fewer are nothing for a task.
MOST_HEAVY, HEAVY = 20_000, 500_000


def _with_least(sides: DataFrame, n_edges: int) -> DataFrame:
    """sides (u, v) with m, the least of u and all its v. sides has at most twice as many rows as there are edges."""
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("m_u"), F.least("u", "m").alias("m"), "n")
    bound = max(HEAVY, -(-2 * n_edges // MOST_HEAVY))
    same = F.col("u") == F.col("m_u")
    if 2 * n_edges < bound:
        return sides.join(least, same).select("u", "v", "m")
    # At most MOST_HEAVY rows: each stands for `bound` rows of sides or more.
    heavy = F.broadcast(least.filter(F.col("n") >= bound).drop("n"))
    light = sides.join(heavy, same, "left_anti").join(least.filter(F.col("n") < bound), same)
    return sides.join(heavy, same).select("u", "v", "m").unionByName(light.select("u", "v", "m"))


def large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(sides, n_edges).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    """Edges lead from a larger u to a smaller v."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _with_least(down, n_edges)
    return joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) of each node with an edge (u, v), nodes being numbers; the component is its least node."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v")).distinct(), "edges")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = print_of(edges)
    for _ in range(rounds):
        edges = written(small_star(large_star(edges, before[0]), before[0]), "edges")
        now = print_of(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
