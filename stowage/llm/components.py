"""Connected components by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.operators.tables import delete, materialise


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, v, m): every pair with the least node among u and all of u's partners.

    The minimum is pre-aggregated before its shuffle and joined back, so that the partners of a hub are never
    gathered in one task: Spark can split the join's side that holds them.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return pairs.join(least, pairs.u == least._u).select("u", "v", "m")


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    small = _least_neighbour(down)
    return (
        small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(small.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("a").alias("a"), F.max("b").alias("b")).where("a > 1 OR a > 0 AND b > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two columns of type long) but the roots themselves.

    root is the least node of the component. Each round is written to the shared folder; the rounds needed
    grow with the logarithm of the longest path. No edges: an empty result. Loops and repeats are allowed,
    nulls are dropped.
    """
    u, v = edges.columns
    now = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
    now = materialise(now.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _settled(now):
        before, now = now, materialise(_round(now), "edges")
        delete(now.sparkSession, before.stored_in)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
