"""Tag clusters: TF-IDF of tag names and weighted K-means, both as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from forumscope.functions.text import tokens
from forumscope.operators.joins import join_lookup
from forumscope.session import shared_folder

# Distances that agree in so many places are equal; the smaller cluster number wins then.
PLACES = 9


def tag_terms(frequency: DataFrame) -> DataFrame:
    """Terms of each tag name with their count in it: (Tag, tag_frequency, term, tf)."""
    exploded = frequency.select("Tag", "tag_frequency", F.explode(tokens(F.col("Tag"))).alias("term"))
    return exploded.groupBy("Tag", "tag_frequency", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_idf(frequency: DataFrame) -> DataFrame:
    """Smoothed inverse document frequency, where every use of a tag is a document."""
    documents = frequency.agg(F.sum("tag_frequency")).scalar()
    return (
        tag_terms(frequency)
        .groupBy("term")
        .agg(F.sum("tag_frequency").alias("df"))
        .select("term", (F.log((1.0 + documents) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    )


def tag_tfidf(frequency: DataFrame) -> DataFrame:
    """Unit-length TF-IDF vector of each tag name, one row for each term."""
    weighted = tag_terms(frequency).join(term_idf(frequency), "term")
    raw = F.col("tf") * F.col("idf")
    length = F.sqrt(F.sum(raw * raw).over(Window.partitionBy("Tag")))
    return weighted.select("Tag", "term", (raw / length).alias("weight"))


def cluster_seeds(frequency: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """The tags that clusters start from, (Tag, cluster): a draw of k tags without replacement, weighted by their frequency.

    Every tag gets an exponential arrival time at the rate of its frequency, from a hash of its name, and the k earliest are drawn;
    the result depends on neither partitions nor order, and only k rows of a task go on.
    """
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "Tag")), 1, 8), 16, 10).cast("double")
    arrival = -F.log((hashed + 0.5) / F.lit(float(1 << 32))) / F.col("tag_frequency")
    drawn = frequency.select("Tag", arrival.alias("_arrival")).orderBy("_arrival", "Tag").limit(k)
    number = F.row_number().over(Window.orderBy("_arrival", "Tag")) - 1
    return drawn.select("Tag", number.alias("cluster"))


def cluster_centres(points: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted means of clusters as rows (cluster, term, centre), and their squared lengths (cluster, norm).

    ``points``: Tag, tag_frequency, term, weight, with a null term for a tag without terms. ``members``: Tag, cluster.
    """
    labelled = points.join(members, "Tag")
    weighted = labelled.groupBy("cluster", "term").agg(F.sum(F.col("tag_frequency") * F.col("weight")).alias("pull"))
    sizes = members.join(points.select("Tag", "tag_frequency").distinct(), "Tag").groupBy("cluster").agg(F.sum("tag_frequency").alias("size"))
    centres = weighted.join(F.broadcast(sizes), "cluster")  # a row a cluster
    centres = centres.select("cluster", "term", (F.col("pull") / F.col("size")).alias("centre")).checkpoint()
    norms = centres.groupBy("cluster").agg(F.sum(F.col("centre") * F.col("centre")).alias("norm"))
    return centres.where("term is not null"), norms


def nearest_centres(points: DataFrame, centres: DataFrame, norms: DataFrame) -> DataFrame:
    """The nearest cluster of each tag, (Tag, cluster).

    A tag meets the centres by the terms they share: one row a term holds all centres that have it, at most one a cluster. A cluster that shares no
    term is as far as its centre is long, so of those only the shortest centre can be nearest.
    """
    by_term = centres.groupBy("term").agg(F.collect_list(F.struct("cluster", "centre")).alias("_all"))
    met = join_lookup(points.where("term is not null"), by_term, "term", F.col("Tag"))
    dots = met.select("Tag", "weight", F.inline("_all")).groupBy("Tag", "cluster").agg(F.sum(F.col("weight") * F.col("centre")).alias("dot"))
    far = F.round(F.col("norm") - 2 * F.col("dot"), PLACES)
    scored = dots.join(F.broadcast(norms), "cluster").groupBy("Tag").agg(F.min(F.struct(far.alias("far"), F.col("cluster"))).alias("best"))
    shortest = norms.agg(F.min(F.struct(F.round("norm", PLACES).alias("far"), F.col("cluster"))).alias("s")).first()["s"]
    if shortest is None:
        return points.select("Tag", F.lit(None).cast("int").alias("cluster")).limit(0)
    other = F.struct(F.lit(shortest["far"]).alias("far"), F.lit(shortest["cluster"]).alias("cluster"))
    every = points.select("Tag").distinct().join(scored, "Tag", "left")
    return every.select("Tag", F.array_min(F.array("best", other))["cluster"].alias("cluster"))


def vector_rows(frequency: DataFrame) -> DataFrame:
    """The TF-IDF rows of all tags with their frequency; a tag without terms is one row with a null term."""
    every = frequency.join(tag_tfidf(frequency), "Tag", "left")
    return every.select("Tag", "tag_frequency", "term", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def tag_clusters(frequency: DataFrame, k: int = 20, max_iterations: int = 100, seed: int = 0) -> DataFrame:
    """Cluster of each tag: (Tag, tag_frequency, cluster), by Lloyd's steps over rows of cluster, term and weight.

    Fitting different tags weighted by frequency has the same objective as fitting every tag row. No vocabulary and no model is
    held anywhere: centres are a table, and the driver sees the number of tags that moved. A cluster that loses all its tags ends. Each step is a
    checkpoint, so a lost executor costs one step.
    """
    shared_folder(frequency.sparkSession)
    frequency = frequency.checkpoint()
    points = vector_rows(frequency).checkpoint()
    members = cluster_seeds(frequency, k, seed).checkpoint()
    for _ in range(max_iterations):
        fresh = nearest_centres(points, *cluster_centres(points, members)).checkpoint()
        before = members.withColumnRenamed("cluster", "_before")
        moved = fresh.join(before, "Tag", "left").where(~F.col("cluster").eqNullSafe(F.col("_before")))
        members = fresh
        if moved.isEmpty():
            break
    return frequency.join(members, "Tag")


def misplaced_tags(clustered: DataFrame) -> DataFrame:
    """How many tags there are, and how many are not in the cluster whose centre is nearest (n_tags, n_misplaced)."""
    shared_folder(clustered.sparkSession)
    clustered = clustered.checkpoint()
    points = vector_rows(clustered.select("Tag", "tag_frequency")).checkpoint()
    nearest = nearest_centres(points, *cluster_centres(points, clustered.select("Tag", "cluster")))
    both = clustered.select("Tag", F.col("cluster").alias("_own")).join(nearest, "Tag")
    return both.agg(F.count("*").alias("n_tags"), F.count_if(F.col("cluster") != F.col("_own")).alias("n_misplaced"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Tag uses and different tags in each cluster, largest first."""
    return (
        clusters.groupBy("cluster")
        .agg(F.sum("tag_frequency").alias("n_rows"), F.count(F.lit(1)).alias("n_tags"))
        .orderBy(F.desc("n_rows"), "cluster")
    )


def cluster_words(clusters: DataFrame) -> DataFrame:
    """Frequency of each tag within its cluster."""
    return clusters.select("cluster", "Tag", F.col("tag_frequency").alias("n"))
