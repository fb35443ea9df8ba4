"""Approximate nearest neighbours by inner product: NN-descent builds a graph, greedy search walks it.

Equal vectors are one node, so thousands of copies cost one place in the graph. Vectors get one more component that makes
all norms equal, after which the largest inner product is the smallest distance. The graph starts from exact neighbours
in small random blocks (signs of random projections). Then rounds of NN-descent: every node joins its neighbours and a
bounded sample of the nodes that point to it, and pairs of these that have not met are compared (neighbours of
neighbours); what is nearer than a node's farthest neighbour replaces it. The rounds are Spark joins and groupings with at
most ``2 * DEGREE`` members a group, until few edges change.

A query is a row of the index and starts from its own node; in each round it expands the best nodes not yet expanded among its ``BEAM`` best, until there are none. The best are then compared exactly, in double
precision on the original vectors.

The index holds every vector; only half-precision codes move in the joins. State is written to the shared folder after every
round, and a query's state has at most ``BEAM`` rows.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, nor do those whose length is not the most
frequent one (of equally frequent ones the smallest), nor rows without an id; copies of a vector are candidates each, ties go to the smaller id; rows that share an
id and a vector count once; fewer candidates than asked for are all returned as far as they are found; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from forumscope.llm.common import map_arrow, small, stored, table

NEAREST = 20
DEGREE = 40
BEAM = 96
EXPAND = 24
BLOCK = 400
STARTS = 3
ROUNDS = 8
SETTLED = 0.02
SEARCH_ROUNDS = 12
SEED = 7


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with an id and a finite vector that is not zero, of the most frequent length."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = rows.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    sizes = good.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size(v) == (sizes["n"] if sizes else 0))


def distinct_vectors(rows: DataFrame, nearest: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, vec, h1, h2), named by the least id of a vector, and members: the ``nearest + 1`` least ids of each."""
    hashed = rows.select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(SEED), "vec").alias("h2"))
    hashed = stored(hashed.dropDuplicates(["id", "h1", "h2"]), "ann-rows")
    copies = Window.partitionBy("h1", "h2").orderBy("id")
    first = hashed.select("id", "h1", "h2").withColumn("rank", F.row_number().over(copies)).where(F.col("rank") <= nearest + 1)
    first = stored(first.withColumn("node", F.first("id").over(copies)), "ann-members")
    heads = first.where("rank = 1").select(F.col("node"), F.col("h1").alias("a"), F.col("h2").alias("b"))
    same = (F.col("id") == F.col("node")) & (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))
    nodes = hashed.join(heads, same).select("node", "vec", "h1", "h2")
    return stored(nodes, "ann-nodes"), first.select("node", "id", "h1", "h2")


def codes(nodes: DataFrame) -> DataFrame:
    """node and its half-precision vector, scaled to norm one with one more component."""
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    longest = float(np.sqrt(nodes.agg(F.max(norm).alias("n")).first()["n"] or 1.0))

    def make():
        def work(batch: pa.RecordBatch) -> dict | None:
            if not batch.num_rows:
                return None
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(batch.num_rows, -1) / longest
            rest = np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))
            made = np.hstack([x, rest[:, None]]).astype(np.float16)
            return {"node": batch.column("node"), "code": [row.tobytes() for row in made]}

        return work

    return map_arrow(nodes.select("node", "vec"), "node bigint, code binary", make)


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float16).reshape(len(rows), -1).astype(np.float32)


def _compare(groups: DataFrame, keep: int, within: bool) -> DataFrame:
    """Pairs u, v, s of each group's members (arrays ids, least, fresh, codes).

    ``within``: the ``keep`` nearest of each member. Otherwise all pairs with a fresh member that are nearer
    than u's farthest neighbour.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict | None:
            us, vs, ss = [], [], []
            for row in range(batch.num_rows):
                ids = np.array(batch.column("ids")[row].as_py())
                if len(ids) < 2:
                    continue
                x = _matrix(batch.column("codes")[row].values)
                s = x @ x.T
                np.fill_diagonal(s, -4)
                if within:
                    k = min(keep, len(ids) - 1)
                    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    u = np.repeat(np.arange(len(ids)), k)
                    v = at.ravel()
                else:
                    fresh = np.array(batch.column("fresh")[row].as_py(), dtype=bool)
                    least = np.array(batch.column("least")[row].as_py(), dtype=np.float32)
                    u, v = np.nonzero((s > least[:, None]) & (fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :]))
                us.append(ids[u])
                vs.append(ids[v])
                ss.append(s[u, v])
            if not us:
                return None
            made = {"u": np.concatenate(us), "v": np.concatenate(vs), "s": np.concatenate(ss)}
            return {n: pa.array(a) for n, a in made.items()}

        return work

    return map_arrow(groups, "u bigint, v bigint, s float", make)


def _top(edges: DataFrame, owner: str, order: list[Column], n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(owner).orderBy(*order))
    return edges.withColumn("_place", place).where(F.col("_place") <= n)


def starting_edges(coded: DataFrame, degree: int) -> DataFrame:
    """Exact neighbours within random blocks, ``STARTS`` times over."""
    n = coded.count()
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / BLOCK))))
    made = []
    for start in range(STARTS if bits else 1):

        def make(start=start):
            def work(batch: pa.RecordBatch) -> dict | None:
                if not batch.num_rows:
                    return None
                x = _matrix(batch.column("code"))
                planes = np.random.default_rng([SEED, start]).standard_normal((x.shape[1], bits)).astype(np.float32)
                sign = ((x @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                return {"node": batch.column("node"), "code": batch.column("code"), "block": pa.array(sign)}

            return work

        blocks = map_arrow(coded, "node bigint, code binary, block bigint", make)
        sizes = blocks.groupBy("block").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
        part = F.pmod(F.xxhash64("node", F.lit(start)), F.col("parts"))
        split = blocks.join(sizes, "block").select("node", "code", "block", part.alias("part"))
        groups = split.groupBy("block", "part").agg(
            F.collect_list("node").alias("ids"), F.collect_list("code").alias("codes")
        )
        made.append(_compare(groups.select("ids", "codes"), degree, within=True))
    edges = reduce(DataFrame.union, made).groupBy("u", "v").agg(F.max("s").alias("s"))
    best = _top(edges, "u", [F.desc("s"), F.asc("v")], degree)
    return stored(best.select("u", "v", "s", F.lit(True).alias("fresh")), "ann-graph-0")


def around(edges: DataFrame, degree: int) -> DataFrame:
    """For every node w its neighbours v and a sample of the nodes that point to it, each once."""
    back = _top(edges.select(F.col("v").alias("w"), F.col("u").alias("v"), "fresh"), "w", [F.desc("fresh"), F.xxhash64("w", "v")], degree)
    both = edges.select(F.col("u").alias("w"), "v", "fresh").union(back.select("w", "v", "fresh"))
    return both.groupBy("w", "v").agg(F.max("fresh").alias("fresh"))


def descend(coded: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph u, v, s with ``degree`` neighbours a node."""
    edges = starting_edges(coded, degree)
    total = edges.count()
    for turn in range(1, rounds + 1):
        members = around(edges, degree)
        active = members.where("fresh").select("w").distinct()  # where all have met, nothing is compared again
        farthest = edges.groupBy("u").agg(F.min("s").alias("low"), F.count("*").alias("n"))
        least = F.when(F.col("n") < degree, F.lit(-4.0)).otherwise(F.col("low")).cast("float")
        known = coded.join(farthest.select(F.col("u").alias("node"), least.alias("least")), "node", "left")
        known = known.withColumn("least", F.coalesce("least", F.lit(-4.0).cast("float")))
        groups = (
            members.join(active, "w")
            .join(known, F.col("v") == F.col("node"))
            .groupBy("w")
            .agg(
                F.collect_list("v").alias("ids"),
                F.collect_list("least").alias("least"),
                F.collect_list("fresh").alias("fresh"),
                F.collect_list("code").alias("codes"),
            )
        )
        met = _compare(groups.drop("w"), degree, within=False).groupBy("u", "v").agg(F.max("s").alias("s"))
        old = edges.select("u", "v", "s", F.lit(False).alias("fresh"))
        joined = old.union(met.select("u", "v", "s", F.lit(True).alias("fresh")))
        joined = joined.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"))
        best = _top(joined, "u", [F.desc("s"), F.asc("v")], degree)
        edges = stored(best.select("u", "v", "s", "fresh"), f"ann-graph-{turn}")
        changed = edges.where("fresh").count()
        if changed <= SETTLED * total:
            break
    return edges


def _scored(pairs: DataFrame, coded: DataFrame, queries: DataFrame) -> DataFrame:
    """Pairs q, v with their similarity by codes."""

    def make():
        def work(batch: pa.RecordBatch) -> dict | None:
            if not batch.num_rows:
                return None
            x, query = _matrix(batch.column("code")), _matrix(batch.column("query"))
            s = np.einsum("ij,ij->i", x[:, :-1], query[:, :-1])  # the component that evens out norms is no part of a query
            return {"q": batch.column("q"), "v": batch.column("v"), "s": pa.array(s)}

        return work

    found = pairs.join(coded, F.col("v") == F.col("node")).join(queries, "q").select("q", "v", "code", "query")
    return map_arrow(found, "q bigint, v bigint, s float", make)


def search(edges: DataFrame, coded: DataFrame, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """The ``beam`` best nodes v that greedy search finds for each query node q: q, v, s.

    ``queries``: q, a node of the graph, where the search starts.
    """
    links = stored(around(edges, DEGREE).select("w", "v"), "ann-links")
    asked = queries.join(coded, F.col("q") == F.col("node")).select("q", F.col("code").alias("query"))
    asked = stored(asked, "ann-queries")
    state = asked.select("q", F.col("q").alias("v"), F.lit(1.0).cast("float").alias("s"), F.lit(False).alias("done"))
    for turn in range(SEARCH_ROUNDS):
        chosen = _top(state.where("not done"), "q", [F.desc("s"), F.asc("v")], EXPAND).select("q", F.col("v").alias("w"))
        reached = chosen.join(links, "w").select("q", "v").distinct()
        new = reached.join(state.select("q", "v"), ["q", "v"], "left_anti")
        expanded = state.join(chosen.withColumnRenamed("w", "v").withColumn("now", F.lit(True)), ["q", "v"], "left")
        expanded = expanded.select("q", "v", "s", (F.col("done") | F.col("now").isNotNull()).alias("done"))
        scored = _scored(new, coded, asked).withColumn("done", F.lit(False))
        best = _top(expanded.union(scored), "q", [F.desc("s"), F.asc("v")], beam)
        state = stored(best.select("q", "v", "s", "done"), f"ann-state-{turn}")
        if state.where("not done").isEmpty():
            break
    return state.select("q", "v", "s")


def nearest(rows: DataFrame, asked: Column, n: int = NEAREST) -> DataFrame:
    """For the rows that ``asked`` selects, the n nearest others: query_id, rank, vec_id, score.

    ``rows``: id and vec.
    """
    good = usable(rows.where("id is not null"), "vec")
    nodes, members = distinct_vectors(good, n)
    coded = stored(codes(nodes), "ann-codes")
    edges = descend(coded)
    named = nodes.select("node", F.col("h1").alias("a"), F.col("h2").alias("b"))
    wanted = good.where(asked).select("id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(SEED), "vec").alias("h2")).distinct()
    wanted = wanted.join(small(named), (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b"))).select("id", "node")
    wanted = stored(wanted, "ann-wanted")
    found = search(edges, coded, wanted.select(F.col("node").alias("q")).distinct())
    vectors = nodes.select("node", "vec")
    dot = F.aggregate(
        F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, p: s + p
    )
    exact = (
        found.select("q", "v")
        .join(vectors.select(F.col("node").alias("v"), F.col("vec").alias("y")), "v")
        .join(vectors.select(F.col("node").alias("q"), F.col("vec").alias("x")), "q")
        .select("q", "v", dot.alias("score"))
    )
    order = [F.desc("score"), F.asc("id")]
    each = _top(exact, "q", [F.desc("score"), F.asc("v")], n + 1).select("q", "v", "score")
    each = each.join(members.select(F.col("node").alias("v"), "id"), "v").select("q", "id", "score")
    each = stored(_top(each, "q", order, n + 1).select("q", F.col("id").alias("vec_id"), "score"), "ann-found")
    mine = wanted.select(F.col("id").alias("query_id"), F.col("node").alias("q"))
    pairs = mine.join(small(each), "q").where("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return pairs.withColumn("rank", place).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", "score")


def op2_nearest(spark, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").alias("vec"))
    return nearest(rows, F.col("id") % 20 == 0)
