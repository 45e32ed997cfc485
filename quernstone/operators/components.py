"""Connected components by alternating star contraction.

Large star links every larger neighbour of a node to the smallest node around it, small star every smaller one; both keep
the components and shrink the paths, so the number of rounds grows with the logarithm of the graph, and the edges never
outnumber those of the start. Hubs: minima are combined before the shuffle, and the join that hands them out is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.plans.lineage import Stage, stage

MOST_ROUNDS = 100


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of ``edges`` (u > v)."""
    towards = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = towards.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    met = towards.join(least, F.col("u") == F.col("c"))
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _kept(edges: DataFrame) -> Stage:
    """The edges as a table, with their number and a checksum; both are equal for equal edge sets."""
    return stage(edges, edges=F.count("*"), checksum=F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)))


def connected_components(vertices: DataFrame, edges: DataFrame, vertex: str = "block_id") -> DataFrame:
    """(``vertex``, component) of every vertex: the smallest vertex that it reaches; vertices without edges keep their own.

    ``edges`` has two columns of vertices; null ends and loops are ignored, direction and repeats don't matter. A round is one
    table in the shared folder, counted while it is written; the one before is dropped.
    """
    a, b = edges.columns[:2]
    held = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    held = _kept(held.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    settled = not held.counts["edges"]
    for _ in range(MOST_ROUNDS):
        if settled:
            break
        last, held = held, _kept(_star(_star(held.df, large=True), large=False))
        settled = last.counts == held.counts
        last.drop()
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    held = held.df
    roots = held.select(F.col("u").alias(vertex), F.col("v").alias("component"))
    return vertices.select(vertex).distinct().join(roots, vertex, "left").select(vertex, F.coalesce("component", vertex).alias("component"))
