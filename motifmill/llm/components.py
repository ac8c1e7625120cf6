"""Connected components by alternating large and small stars, as joins and aggregates over written edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large(edges: DataFrame) -> DataFrame:
    """Each node points its larger neighbours at the smallest node around it."""
    both = edges.union(edges.select("b", "a"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node points itself and its smaller neighbours at the smallest of them. edges: u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node of the component) for each node of an edge (a, b). Self-loops and repeated edges do no harm."""
    now = materialise(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        stars = materialise(_small(_large(now).where("u != v").distinct()).where("u != v").distinct(), "stars")
        # Done once every node has one edge, to a node that has none of its own.
        tangled = stars.groupBy("u").count().where("count > 1").select("u").union(stars.select(F.col("v").alias("u")).join(stars.select("u"), "u", "left_semi")).limit(1).count()
        if not tangled:
            break
        now = stars.select(F.col("v").alias("a"), F.col("u").alias("b"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)
