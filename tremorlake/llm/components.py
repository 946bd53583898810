"""Connected components of a graph given as rows of links, by alternating star operations."""

from pyspark.sql import functions as F

from .common import stored


def _state(edges):
    row = edges.agg(F.count("*").alias("n"), F.sum(
        F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def _large(edges):
    """Link every larger neighbour of a node to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a and b != m").select(
        F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges):
    """Link a node and its smaller neighbours to the smallest of them; edges go from a down to b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b != m").select(
        F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links):
    """(node, root) for every node of ``links`` (a, b bigint): root is the least node reachable.

    Each round is written to the shared folder. Nothing gathers a node's neighbours: minima are
    aggregated, and the joins on a popular node can be split.
    """
    edges = stored(links.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(edges)
    while True:
        edges = stored(_small(_large(edges)), "stars")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
