"""Connected components by random contraction: every round joins each node to the least name around it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forumscope.llm.common import stored

ONE_TASK = 1_000_000  # links that one task can join: some 100 MB of working memory


def least_places(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of the places below ``n`` the least one of its component; a[i] and b[i] are linked."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    return root


def joined(edges: DataFrame) -> DataFrame:
    """_from and _to, the least name of its component, of all names in ``edges`` (a, b), by one task."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if ends:
            names, places = np.unique(np.concatenate([np.concatenate(c) for c in zip(*ends, strict=True)]), return_inverse=True)
            least = least_places(len(names), *np.split(places.reshape(-1), 2))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[least])], ["_from", "_to"])

    return edges.select("a", "b").coalesce(1).mapInArrow(join, "_from bigint, _to bigint")


def components(links: DataFrame) -> DataFrame:
    """``links``: columns a and b (bigint). One row a node that has a link: node, root; equal roots are connected.

    Nodes are renamed by a hash in each round, so which neighbour is least is random and a round removes a constant
    share of the nodes whatever the graph's shape: a long chain takes as few rounds as a star. (The hash of one
    64-bit number is a bijection: names never collide.) The least name is found by grouping, combined before the
    shuffle; the joins have one row a node on one side, so adaptive execution can split a hub's links. Each
    round is a written table; nothing reaches the driver but how many links are left. The last ``ONE_TASK`` links are joined by one task.
    """
    links = links.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    links = stored(links.where("a <> b"), "links")
    nodes = links.select(F.col("_a").alias("node"), F.col("a").alias("name")).union(links.select("_b", "b")).distinct()
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rounds = 0
    while True:
        edges = stored(edges, f"edges-{rounds}")
        left = edges.count()
        if not left:
            return nodes.select("node", F.col("name").alias("root"))
        if left <= ONE_TASK:
            target = stored(joined(edges), f"targets-{rounds}")
            named = nodes.join(target, F.col("name") == F.col("_from"), "left")
            return stored(named.select("node", F.coalesce("_to", "name").alias("root")), f"nodes-{rounds}")
        around = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("_least"))
        target = stored(around.select(F.col("a").alias("_from"), F.least("a", "_least").alias("_to")), f"targets-{rounds}")
        name = F.xxhash64(F.coalesce("_to", "name"))
        nodes = stored(nodes.join(target, F.col("name") == F.col("_from"), "left").select("node", name.alias("name")), f"nodes-{rounds}")
        left = edges.join(target, F.col("a") == F.col("_from")).select(F.col("_to").alias("a"), "b")
        both = left.join(target, F.col("b") == F.col("_from")).select(F.xxhash64("a").alias("a"), F.xxhash64("_to").alias("b"))
        edges = both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rounds += 1
