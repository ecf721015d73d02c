"""Connected classes of an edge table by alternating large-star and small-star steps."""

from pyspark.sql import functions as F


def _least(edges):
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _is_forest_of_stars(edges):
    """Whether every node has one smaller neighbour at most, which has none itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("lower")).union(edges.select("v", F.lit(0)))
    per = ends.groupBy("node").agg(F.sum("lower").alias("n"), F.min("lower").alias("least"))
    return per.filter("n > 1 OR (n = 1 AND least = 0)").isEmpty()


def connected_classes(links, scratch, rounds=60):
    """``node, comp``: for every node of ``links`` (columns a, b) the smallest node it can reach.

    Each step hangs the neighbours of a node below the smallest one it sees. A node's neighbours are
    read by joins and minima, never gathered in one row, so a star of any size is many small rows.
    Stops when all that is left are stars; the number of steps grows with the logarithm of the length of
    the longest chain.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.keep(edges, "edges")
    for _ in range(rounds):
        if _is_forest_of_stars(edges):
            break
        # Large star: larger neighbours of u move to the least of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: u itself and its smaller neighbours move to the least of them.
        least = _least(large)
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        edges = scratch.keep(small, "edges")
    else:
        raise RuntimeError(f"classes still change after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return scratch.keep(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots.select("node", F.col("node").alias("comp"))), "classes")
