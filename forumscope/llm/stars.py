"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from forumscope.llm.common import stored


def _pointing_down(edges: DataFrame) -> DataFrame:
    """Different edges from a larger node (a) to a smaller one (b); loops go."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Every node sends its larger neighbours to the least node around it."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).withColumnRenamed("a", "_of")
    sent = both.where("b > a").join(least, F.col("a") == F.col("_of"))
    return sent.select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every node sends itself and its smaller neighbours to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "_of")
    sent = edges.join(least, F.col("a") == F.col("_of"))
    return least.union(sent.where("b <> least").select("b", "least")).toDF("a", "b").distinct()


def star_components(links: DataFrame) -> DataFrame:
    """``links``: columns a and b (bigint). One row a node that has a link: node, root, the least node of its component.

    The two steps alternate until no edge changes; every edge then points from a node to its root. Edges never grow in number, the least
    neighbour is found by grouping, combined before the shuffle, and the joins have one row a node on one side, so adaptive execution can split a
    hub's edges. Each round is a written table; the driver sees its count and checksum.
    """
    edges, before = stored(_pointing_down(links), "star-edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if tuple(state) == before or not state[0]:
            ends = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(ends)
        before = tuple(state)
        edges = stored(small_star(large_star(edges)), "star-edges")
