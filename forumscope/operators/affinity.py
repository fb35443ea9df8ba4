"""Groups of similar tag names: edit distance and affinity propagation.

Similar pairs come from an equi-join on shared deletion variants, not from comparing all tags with all
tags. Affinity propagation passes its messages along those pairs only; a pair that is further apart
than the limit has no edge. With a limit of the longest tag every pair is an edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from forumscope.session import shared_folder

# Stands for "no second choice": far below any similarity.
NO_RIVAL = -1.0e9


def similar_tags(tags: DataFrame, max_distance: int) -> DataFrame:
    """All pairs of different tags within the edit distance: (a, b, distance) with a < b.

    Two names within distance d share a name that both reach by at most d deletions. Names that meet
    there are within 2d of each other, so such a meeting is limited by the alphabet and the name
    length, not by the number of tags.
    """
    reach = tags.select("Tag").distinct().withColumn("variant", F.col("Tag"))
    for _ in range(max_distance):
        reach = reach.select(
            "Tag", F.explode(_one_deletion(F.col("variant"))).alias("variant")
        ).distinct()
    left = reach.select(F.col("Tag").alias("a"), "variant")
    right = reach.select(F.col("Tag").alias("b"), "variant")
    candidates = left.join(right, "variant").where(F.col("a") < F.col("b")).select("a", "b").distinct()
    return candidates.withColumn("distance", F.levenshtein("a", "b")).where(
        F.col("distance") <= max_distance
    )


def _one_deletion(name: Column) -> Column:
    """The name itself and every name with one character left out."""
    shorter = F.transform(
        F.sequence(F.lit(1), F.length(name)),
        lambda i: F.concat(F.substring(name, 1, i - 1), F.substring(name, i + 1, F.length(name))),
    )
    whole = F.array(name)
    return F.when(F.length(name) > 0, F.array_union(whole, shorter)).otherwise(whole)


def name_similarity(pairs: DataFrame) -> DataFrame:
    """Edges in both directions with the negated edit distance: (i, k, s)."""
    return _both_ways(pairs.select("a", "b", (-F.col("distance")).alias("s")))


def _closeness(tags: DataFrame, pairs: DataFrame, max_distance: int) -> DataFrame:
    """Rows of distances, sparse: ``limit + 1 - distance`` for each tag and those within the limit, itself included."""
    far = max_distance + 1
    names = tags.select("Tag").distinct()
    return _both_ways(pairs.select("a", "b", (far - F.col("distance")).alias("s"))).unionAll(
        names.select(F.col("Tag").alias("i"), F.col("Tag").alias("k"), F.lit(far).alias("s"))
    )


def profile_halves(tags: DataFrame, pairs: DataFrame, max_distance: int) -> DataFrame:
    """(Tag, half): two tags whose rows share nothing have the similarity half + half, minus both squared lengths."""
    rows = _closeness(tags, pairs, max_distance)
    return rows.groupBy(F.col("i").alias("Tag")).agg((-F.sum(F.col("s") * F.col("s"))).cast("double").alias("half"))


def profile_similarity(tags: DataFrame, pairs: DataFrame, max_distance: int) -> DataFrame:
    """Edges in both directions with the negated squared distance between distance rows: (i, k, s).

    A tag's row holds its distance to every tag, where distances above the limit count as limit + 1. The squared
    difference of two rows follows from their squared lengths and their product over shared neighbours. Every pair
    that shares a neighbour is an edge; any other has the similarity that ``profile_halves`` gives.
    """
    closeness = _closeness(tags, pairs, max_distance)
    lengths = profile_halves(tags, pairs, max_distance)
    first = closeness.select(F.col("i").alias("a"), F.col("k").alias("via"), F.col("s").alias("sa"))
    second = closeness.select(F.col("i").alias("b"), F.col("k").alias("via"), F.col("s").alias("sb"))
    products = (
        first.join(second, "via")
        .where(F.col("a") < F.col("b"))
        .groupBy("a", "b")
        .agg(F.sum(F.col("sa") * F.col("sb")).alias("product"))
    )
    of = {side: lengths.select(F.col("Tag").alias(side), F.col("half").alias(f"half_{side}")) for side in "ab"}
    similarity = F.col("half_a") + F.col("half_b") + 2 * F.col("product")
    return _both_ways(products.join(of["a"], "a").join(of["b"], "b").select("a", "b", similarity.alias("s")))


def _both_ways(pairs: DataFrame) -> DataFrame:
    ways = F.array(
        F.struct(F.col("a").alias("i"), F.col("b").alias("k"), F.col("s").alias("s")),
        F.struct(F.col("b").alias("i"), F.col("a").alias("k"), F.col("s").alias("s")),
    )
    return pairs.select(F.inline(ways))


def affinity_clusters(
    tags: DataFrame,
    edges: DataFrame,
    absent: float | DataFrame,
    preference: float | None = None,
    damping: float = 0.5,
    max_iterations: int = 200,
    stable_iterations: int = 15,
    block: int = 10,
) -> DataFrame:
    """Exemplar of each tag by affinity propagation over similarity edges: (Tag, exemplar).

    ``absent`` is the similarity that a pair without an edge counts with, one for all or (Tag, half) for the sum
    of two halves; the preference defaults to the median over all pairs. A small fixed disturbance from the names breaks ties. Messages are
    checkpointed after each block of iterations, which also ends the growing lineage, and the loop
    ends when no tag has changed its exemplar state for ``stable_iterations``.
    """
    shared_folder(tags.sparkSession)
    edges, names = edges.checkpoint(), tags.select("Tag").distinct()
    halves = absent if isinstance(absent, DataFrame) else names.withColumn("half", F.lit(absent / 2))
    halves = halves.checkpoint()
    if preference is None:
        preference = median_similarity(edges, halves)
    own = names.select(
        F.col("Tag").alias("i"), F.col("Tag").alias("k"), F.lit(float(preference)).alias("s")
    )
    disturbance = F.pmod(F.xxhash64("i", "k"), F.lit(1_000_003)) * 1e-12
    similar = (
        edges.select("i", "k", F.col("s").cast("double").alias("s"))
        .unionAll(own)
        .withColumn("s", F.col("s") * (1.0 + disturbance))
        .checkpoint()
    )
    state = similar.select(
        "*", F.lit(0.0).alias("r"), F.lit(0.0).alias("a"), F.lit(False).alias("leads"), F.lit(0).alias("since")
    )
    done = 0
    while done < max_iterations:
        steps = min(block, max_iterations - done)
        for _ in range(steps):
            state = _pass_messages(state, damping)
        state = state.checkpoint()
        done += steps
        settled = (
            state.where(F.col("i") == F.col("k"))
            .agg(F.min("since").alias("since"), F.count_if("leads").alias("leaders"))
            .first()
        )
        if settled["leaders"] and settled["since"] >= stable_iterations:
            break
    leaders = state.where((F.col("i") == F.col("k")) & F.col("leads")).select("k")
    clusters = _nearest_leader(similar, leaders).checkpoint()
    centres = _cluster_centres(similar, clusters, halves).checkpoint()
    return _nearest_leader(similar, centres).select(F.col("i").alias("Tag"), F.col("leader").alias("exemplar"))


def median_similarity(edges: DataFrame, halves: DataFrame) -> float:
    """Median over all ordered pairs: edges, zero for each tag with itself, the sum of two halves for the rest.

    Every value takes its place by rank, so an edge may lie on either side of an absent pair. Absent pairs are counted by
    the value of their halves, all of them less those that have an edge; values, not pairs, are combined and ordered.
    """
    sizes = halves.groupBy("half").agg(F.count(F.lit(1)).alias("m"))
    listed = sizes.agg(F.collect_list(F.struct("half", "m")).alias("all"))  # the different values of a half
    first = listed.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y"))
    same = F.when(F.col("x.half") == F.col("y.half"), F.col("x.m")).otherwise(0)
    every = first.select((F.col("x.half") + F.col("y.half")).alias("s"), (F.col("x.m") * F.col("y.m") - same).alias("n"))
    of = {side: halves.select(F.col("Tag").alias(side), F.col("half").alias(f"half_{side}")) for side in "ik"}
    joined = edges.join(of["i"], "i").join(of["k"], "k")
    taken = joined.select((F.col("half_i") + F.col("half_k")).alias("s"), F.lit(-1).alias("n"))
    present = edges.select(F.col("s").cast("double").alias("s"), F.lit(1).alias("n"))
    own = halves.select(F.lit(0.0).alias("s"), F.lit(1).alias("n"))
    counts = every.unionAll(taken).unionAll(present).unionAll(own).groupBy("s").agg(F.sum("n").alias("n")).where("n > 0")
    ranked = counts.withColumn("upto", F.sum("n").over(Window.orderBy("s"))).checkpoint()
    total = ranked.agg(F.max("upto")).first()[0]
    if not total:
        return 0.0
    low, high = (
        ranked.where(F.col("upto") > rank).agg(F.min("s").alias("s")).first()["s"]
        for rank in ((total - 1) // 2, total // 2)
    )
    return (low + high) / 2


def _pass_messages(state: DataFrame, damping: float) -> DataFrame:
    """One damped update of responsibilities, then of availabilities.

    A window holds the edges of one tag, at most as many as there are tags, and may spill. Each step
    reads its input once, so a chain of steps stays a linear plan.
    """
    self_edge = F.col("i") == F.col("k")
    by_tag = Window.partitionBy("i").orderBy(F.desc("offer"), "k")
    whole_tag = by_tag.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best, second = F.first("offer").over(whole_tag), F.nth_value("offer", 2).over(whole_tag)
    offers = state.withColumn("offer", F.col("a") + F.col("s"))
    ranked = offers.withColumns(
        {"best": best, "second": second, "place": F.row_number().over(by_tag)}
    )
    rival = F.when(F.col("place") == 1, F.coalesce("second", F.lit(NO_RIVAL))).otherwise(F.col("best"))
    asked = ranked.select(
        "i", "k", "s", "a", "leads", "since",
        (damping * F.col("r") + (1 - damping) * (F.col("s") - rival)).alias("r"),
    )
    at_tag = Window.partitionBy("k")
    wanted = F.greatest("r", F.lit(0.0))
    supported = asked.withColumns(
        {
            "support": F.sum(F.when(~self_edge, wanted).otherwise(0.0)).over(at_tag),
            "own_r": F.max(F.when(self_edge, F.col("r"))).over(at_tag),
        }
    )
    others = F.col("own_r") + F.col("support") - wanted
    fresh = F.when(self_edge, F.col("support")).otherwise(F.least(F.lit(0.0), others))
    updated = supported.select(
        "i", "k", "s", "r", (damping * F.col("a") + (1 - damping) * fresh).alias("a"), "leads", "since"
    )
    leads = self_edge & (F.col("r") + F.col("a") > 0)
    return updated.select(
        "i", "k", "s", "r", "a",
        leads.alias("leads"),
        F.when(leads == F.col("leads"), F.col("since") + 1).otherwise(0).alias("since"),
    )


def _nearest_leader(similar: DataFrame, leaders: DataFrame) -> DataFrame:
    """Each node's most similar leader; a leader, or a node without one in reach, leads itself."""
    choices = similar.join(leaders.withColumn("led", F.lit(True)), "k", "left")
    self_edge = F.col("i") == F.col("k")
    wish = F.when(F.col("led"), F.struct("s", "k"))
    own = F.max(F.when(self_edge & F.col("led"), F.col("k")))
    return choices.groupBy("i").agg(
        F.coalesce(own, F.max(wish)["k"], F.max("i")).alias("leader")
    )


def _cluster_centres(similar: DataFrame, clusters: DataFrame, halves: DataFrame) -> DataFrame:
    """The member of each cluster with the highest total similarity from all members: (k).

    Members without an edge to k count with their halves and k's.
    """
    named = clusters.join(halves.withColumnRenamed("Tag", "i"), "i")
    of_i = named.select("i", F.col("leader").alias("cluster"), "half")
    of_k = named.select(F.col("i").alias("k"), F.col("leader").alias("cluster"), F.col("half").alias("own"))
    sizes = of_i.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("half").alias("halves"))
    unknown = F.col("size") - F.col("known")
    totals = (
        similar.join(of_i, "i")
        .join(of_k, ["k", "cluster"])
        .groupBy("cluster", "k", "own")
        .agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("known"), F.sum("half").alias("known_halves"))
        .join(sizes, "cluster")
        .withColumn("total", F.col("s") + F.col("halves") - F.col("known_halves") + unknown * F.col("own"))
    )
    return totals.groupBy("cluster").agg(F.max(F.struct("total", "k"))["k"].alias("k")).select("k")


def cluster_members(clusters: DataFrame) -> DataFrame:
    """Members of each exemplar in order, with the size of its cluster."""
    sizes = clusters.groupBy("exemplar").agg(F.count(F.lit(1)).alias("n_members"))
    return (
        clusters.join(sizes, "exemplar")
        .select("exemplar", "n_members", F.col("Tag").alias("member"))
        .orderBy("exemplar", "member")
    )
