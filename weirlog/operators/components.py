"""Minimum-label connected components by large-star and small-star rounds over DataFrames.

Edges are undirected. Every round is two grouped minima with a join back, so a vertex with very many
neighbours is aggregated before the shuffle and its join is one that AQE can split. The edge set is
written to the shared folder after each round; the loop ends when count and hashes of the set repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirlog.sources.shared import materialise


def _oriented(a, b, df: DataFrame) -> DataFrame:
    """Distinct pairs (u, v) with u > v."""
    return df.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(centre, m): the least of each vertex and its neighbours."""
    both = pairs.select(F.col("u").alias("centre"), F.col("v").alias("m")).union(pairs.select("v", F.col("v")))
    return both.groupBy("centre").agg(F.min("m").alias("m"))


def large_star(pairs: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a vertex to the least vertex around it."""
    least = _least_neighbour(pairs)
    return pairs.join(least, F.col("v") == F.col("centre")).select("u", F.col("m").alias("v")).distinct()


def small_star(pairs: DataFrame) -> DataFrame:
    """Joins every smaller neighbour of a vertex, and the vertex, to the least of them."""
    least = pairs.groupBy(F.col("u").alias("centre")).agg(F.min("v").alias("m"))
    met = pairs.join(least, F.col("u") == F.col("centre"))
    return met.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(vertex, label) for every endpoint of edges (two columns) and every explicit vertex (one column).

    A self loop gives a vertex; nulls are ignored; repeated rows count once.
    """
    edges = edges.toDF("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    pairs, mark = materialise(_oriented(F.col("a"), F.col("b"), edges), "stars"), None
    while mark != (mark := _mark(pairs)) and mark[0]:
        pairs = materialise(small_star(large_star(pairs)), "stars")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("vertex"))
    if vertices is not None:
        nodes = nodes.union(vertices.toDF("vertex").where("vertex IS NOT NULL"))
    labels = pairs.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return nodes.distinct().join(labels, "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("label"))
