"""Document quality by hierarchical empirical Bayes: the text's evidence with what its host and path are like.

A logistic classifier over a text's form gives each document evidence: the log-odds of being good, without the base
rate. Documents are then counted by host (``source``) and path (``source`` and ``lang``) with their expected number of
good ones. A host's rate is its own mean shrunk toward the global rate, a path's rate its mean shrunk toward
its host's; how strongly is estimated from the spread between sites (method of moments for a beta distribution), so a
sparse site follows the sites above it and a large one itself. The posterior of a document adds its evidence to the log-odds
of its path. A site's own document is left out of its mean, so no text counts twice.

Sums by site are combined before the shuffle, so a host with a third of all rows costs no more than another.
The classifier is fitted on at most ``FIT_ROWS`` labelled documents, chosen by a hash of their ids; everything else
covers all documents.

Defined results: a null, empty or blank text has no words and is scored by its form like any other, as junk; null hosts
and paths are sites of their own; rows that share a doc_id are scored each; labels that are null, or more than one
a document, are ignored and averaged; without labels of both kinds the evidence is zero and everything is kept; an
empty table gives an empty result; other columns are ignored, or carried by ``keep_good``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from forumscope.llm.common import packed, small, stable_hash, stored, table
from forumscope.llm.measures import MEASURES, measured
from forumscope.operators.joins import fits_broadcast

FIT_ROWS = 20_000
THRESHOLD = 0.5
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1e6


def features() -> list[Column]:
    """The text's form as bounded numbers."""
    share = lambda part, whole: F.col(part) / F.greatest(F.col(whole), F.lit(1))
    symbols = share("n_symbols", "n_words")
    return [
        F.least(symbols, F.lit(1.0)),
        F.when(symbols > 0.1, 1.0).otherwise(0.0),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
        F.least(share("word_chars", "n_words") / 10, F.lit(2.0)),
        share("n_plain", "n_words"),
        share("n_distinct", "n_words"),
        F.least(share("n_stops", "n_words") * 5, F.lit(2.0)),
        F.least(share("n_words", "n_lines") / 20, F.lit(2.0)),
        F.log1p(F.col("n_words")) / 10,
        F.when(F.col("n_words") == 0, 1.0).otherwise(0.0),
    ]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, rounds: int = 60) -> np.ndarray:
    """Penalised logistic regression by Newton's method; the last weight is the intercept, without penalty."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _row() -> Column:
    """A hash of what a row is judged by; nulls are marked, as the hash skips them."""
    parts = ["doc_id", "source", "lang", "text"]
    return F.xxhash64(*parts, *[F.col(c).isNull() for c in parts])


def evidence(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, source, lang, row and the log-odds that the text alone is good, without the base rate."""
    carried = docs.select("doc_id", "source", "lang", "text", _row().alias("row"))
    made = measured(carried, "doc_id", "source", "lang", "row").withColumn("_x", F.array(*features()))
    made = stored(made.drop(*MEASURES), "quality-form")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.avg("quality").alias("_y")
    )
    chosen = known.orderBy(stable_hash(F.col("doc_id")), "doc_id").limit(fit_rows)
    if fits_broadcast(chosen):  # at most fit_rows rows
        chosen = F.broadcast(chosen)
    sample = made.join(chosen, "doc_id").select("_x", "_y").limit(2 * fit_rows).collect()
    y = np.array([r["_y"] for r in sample], dtype=float)
    score = F.lit(0.0)
    if len(y) and 0 < y.mean() < 1:
        w = fit_logistic(np.array([r["_x"] for r in sample], dtype=float), y)
        score = sum((F.col("_x")[i] * float(v) for i, v in enumerate(w[:-1])), F.lit(float(w[-1])))
        score = score - float(np.log(y.mean() / (1 - y.mean())))
    return made.withColumn("evidence", F.greatest(F.least(score, F.lit(12.0)), F.lit(-12.0))).drop("_x")


def _strength(sites: DataFrame, rate: str) -> float:
    """How many documents a site's prior counts for: from the spread of the sites' means around theirs.

    Var(mean) = p(1-p)(1/n + (1 - 1/n)/(s + 1)) for a beta prior of strength s; solved for s over all sites.
    """
    noise = F.col(rate) * (1 - F.col(rate))
    got = sites.where("n > 1").agg(
        F.sum(F.col("n") * (F.col("good") / F.col("n") - F.col(rate)) ** 2).alias("spread"),
        F.sum(noise).alias("noise"),
        F.sum(noise * (F.col("n") - 1)).alias("scale"),
    ).first()
    if not got["scale"] or got["spread"] is None:
        return MIN_STRENGTH
    between = max((got["spread"] - got["noise"]) / got["scale"], 1 / (MAX_STRENGTH + 1))
    return float(np.clip(1 / between - 1, MIN_STRENGTH, MAX_STRENGTH))


def judged(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: row, doc_id, evidence, host_rate, path_rate, posterior, kept."""
    scored = stored(evidence(docs, labels, fit_rows), "quality-evidence")
    scored = scored.withColumn("_good", 1 / (1 + F.exp(-F.col("evidence"))))
    paths = scored.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("_good").alias("good"))
    paths = stored(paths, "quality-paths")
    hosts = paths.groupBy("source").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = (total["good"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    host_strength = _strength(hosts.withColumn("rate", F.lit(rate)), "rate")
    hosts = hosts.withColumn("host_rate", (F.col("good") + host_strength * rate) / (F.col("n") + host_strength))
    by_host = Window.partitionBy("source")
    sites = (
        paths.withColumn("_n", F.sum("n").over(by_host))
        .withColumn("_host", F.sum("good").over(by_host))
        .withColumn("host_rate", (F.col("_host") + host_strength * rate) / (F.col("_n") + host_strength))
    )
    path_strength = _strength(sites, "host_rate")
    sites = sites.select(
        F.struct("source", "lang").alias("_site"), F.col("n").alias("_count"), F.col("good").alias("_sum"), "host_rate"
    )
    scored = scored.withColumn("_site", F.struct("source", "lang"))
    if fits_broadcast(sites.select("_site.source", "_site.lang")):
        sites = F.broadcast(sites)
    path = (F.col("_sum") - F.col("_good") + path_strength * F.col("host_rate")) / (F.col("_count") - 1 + path_strength)
    odds = F.col("evidence") + F.log(F.col("path_rate") / (1 - F.col("path_rate")))
    return (
        scored.alias("d")
        .join(sites.withColumnRenamed("_site", "_key"), F.col("_site").eqNullSafe(F.col("_key")))
        .withColumn("path_rate", F.greatest(F.least(path, F.lit(0.999)), F.lit(0.001)))
        .withColumn("posterior", 1 / (1 + F.exp(-odds)))
        .withColumn("kept", F.col("posterior") >= threshold)
        .select("row", "doc_id", "evidence", "host_rate", "path_rate", "posterior", "kept")
    )


def posteriors(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, evidence, host_rate, path_rate, posterior, kept."""
    return judged(docs, labels, fit_rows, threshold).drop("row")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns; each row is decided by itself, whatever other rows share its doc_id."""
    rejected = judged(docs, labels).where(~F.col("kept")).select(F.col("row").alias("_gone")).distinct()
    rejected = small(stored(rejected, "quality-rejected"))
    rows = docs.select(packed(docs), _row().alias("_id"))
    return rows.join(rejected, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")


def op7_quality(spark, folder: str) -> DataFrame:
    return posteriors(table(spark, folder, "documents"), table(spark, folder, "labels"))
