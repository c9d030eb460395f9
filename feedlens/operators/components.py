"""Connected components by alternating star contraction.

Large-star / small-star after Kiveris et al., "Connected Components in
MapReduce and Beyond" (2014). The state is a set of edges ``(hi, lo)`` with
``lo < hi``; every round moves edges towards the smallest vertex of their
component until each component is a star around it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlens.operators.skew import salted_lookup
from feedlens.sources.durable import durable, scratch_path


def _state(links: DataFrame) -> tuple[int, bool]:
    """Number of edges, and whether they form stars already: every ``hi`` has
    one edge and no ``lo`` of one edge is the ``hi`` of another."""
    role = F.inline(
        F.array(
            F.struct(F.col("hi").alias("id"), F.lit(1).alias("as_hi"), F.lit(0).alias("as_lo")),
            F.struct(F.col("lo").alias("id"), F.lit(0).alias("as_hi"), F.lit(1).alias("as_lo")),
        )
    )
    per_vertex = links.select(role).groupBy("id").agg(F.sum("as_hi").alias("hi"), F.max("as_lo").alias("lo"))
    is_star = (F.col("hi") == 0) | ((F.col("hi") == 1) & (F.col("lo") == 0))
    row = per_vertex.agg(F.coalesce(F.sum("hi"), F.lit(0)).alias("n"), F.coalesce(F.bool_and(is_star), F.lit(True)).alias("done")).first()
    return row["n"], row["done"]


def _smallest(links: DataFrame, vertex: str) -> DataFrame:
    """Smallest neighbour below each ``hi``, one row per vertex."""
    return links.groupBy(F.col("hi").alias(vertex)).agg(F.min("lo").alias("m"))


def _large_star(links: DataFrame, n: int, **skew) -> DataFrame:
    """Attach every larger neighbour of a vertex to the vertex's minimum.

    Edge ``(hi, lo)`` becomes ``(hi, m(lo))``; a ``lo`` without a smaller
    neighbour is its own minimum.
    """
    joined = salted_lookup(links, _smallest(links, "lo"), "lo", ["hi"], "left", n, **skew)
    return joined.select("hi", F.coalesce("m", "lo").alias("lo")).distinct()


def _small_star(links: DataFrame, n: int, **skew) -> DataFrame:
    """Attach a vertex and its smaller neighbours to the smallest of them."""
    joined = salted_lookup(links, _smallest(links, "hi"), "hi", ["lo"], "inner", n, **skew)
    pairs = F.array(
        F.struct(F.col("hi"), F.col("m").alias("lo")),
        F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")),
    )
    return joined.select(F.inline(pairs)).where("hi <> lo").distinct()


def component_links(edges: DataFrame, **skew) -> DataFrame:
    """``(hi, lo)`` per non-minimal vertex: the vertex and its component.

    Every half round is written to the shared scratch folder, which cuts the
    lineage and survives lost executors. Two folders take turns, so the disk
    holds two generations of edges at most. The number of rounds grows with the
    logarithm of the graph size.
    """
    spark = edges.sparkSession
    slots = [scratch_path(spark, "components"), scratch_path(spark, "components")]
    oriented = edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
    links = durable(oriented.where("hi <> lo").distinct(), path=slots[0])
    n, done = _state(links)
    while not done:
        links = durable(_large_star(links, n, **skew), path=slots[1])
        links = durable(_small_star(links, n, **skew), path=slots[0])
        n, done = _state(links)
    return links


def connected_components(vertices: DataFrame, edges: DataFrame, **skew) -> DataFrame:
    """Vertex columns plus ``component``, the smallest vertex id reachable.

    Edge direction, parallel edges and self-loops play no role; a vertex
    without edges is its own component.
    """
    links = component_links(edges, **skew).select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return vertices.join(links, "id", "left").withColumn("component", F.coalesce("component", "id"))


def component_stats(components: DataFrame) -> DataFrame:
    """Number of components and average number of vertex rows in each."""
    per = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("n_components"),
        F.try_divide(F.sum("n"), F.count(F.lit(1))).alias("avg_vertices"),
    )
