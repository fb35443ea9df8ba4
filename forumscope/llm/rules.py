"""Quality rules by weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Each rule reads the measures of a text and votes +1 (good), -1 (bad) or 0 (abstains). The votes of a document are
one of 3**m patterns; the corpus is counted by pattern (combined before the shuffle), and the expectation-
maximisation runs over these counts, so its cost does not depend on the number of documents: with the eight rules
here at most 6,561 rows reach the driver, in practice a few dozen. It finds each rule's chance of each vote on good
and on bad documents and the share of good ones. A document is kept if it passes the base rules and its posterior
probability of being good is at least ``KEEP``.

Defined results: a null, empty or blank text has no words and fails the base rules; a null doc_id is carried; repeated
rows are scored alike, each in its own row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from forumscope.llm.common import stored, table
from forumscope.llm.measures import measured

MIN_WORDS = 50
KEEP = 0.5
ROUNDS = 200


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def votes() -> dict[str, Column]:
    """The rules: name to vote. A rule that finds one fault votes bad or abstains; two rules vote for good form."""
    symbols, lines = _share("n_symbols", "n_words"), _share("n_dup_lines", "n_lines")
    repeat, length = _share("n_repeat_words", "n_words"), _share("word_chars", "n_words")
    plain, distinct = _share("n_plain", "n_words"), _share("n_distinct", "n_words")
    per_line, ends = _share("n_words", "n_lines"), _share("n_stops", "n_words")
    bad = {
        "symbols": symbols > 0.12,
        "lines": (lines > 0.3) & (F.col("n_lines") > 3),
        "repeats": repeat > 0.35,
        "length": (length < 2.5) | (length > 14),
        "plain": plain < 0.7,
        "variety": (distinct < 0.12) & (F.col("n_words") < 5000),
    }
    good = {
        "prose": (ends > 0.015) & (per_line > 4) & (symbols < 0.06) & (plain > 0.8),
        "varied": (repeat < 0.2) & (lines < 0.2) & (symbols < 0.06) & (distinct > 0.15),
    }
    return {n: F.when(c, -1).otherwise(0) for n, c in bad.items()} | {
        n: F.when(c, 1).otherwise(0) for n, c in good.items()
    }


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern, and each rule's accuracy where it votes.

    ``patterns``: one row a pattern of -1, 0, 1; ``counts``: its documents. Starts from the majority of votes. A
    vote's chance given the label has a weak prior that rules are better than chance, which keeps the two classes
    from swapping; a rule that never votes has no weight.
    """
    if not len(patterns):
        return np.zeros(0), np.full(patterns.shape[1] if patterns.ndim == 2 else 0, 0.5)
    weight = counts.astype(float)
    total = weight.sum()
    posterior = 1 / (1 + np.exp(-1.5 * patterns.sum(axis=1)))
    is_vote = np.stack([patterns == v for v in (-1, 0, 1)])  # vote, pattern, rule
    prior = {True: np.array([0.2, 0.5, 0.8]), False: np.array([0.8, 0.5, 0.2])}
    strength = 0.01 * total + 1
    for _ in range(rounds):
        share = np.clip((weight * posterior).sum() / total, 0.02, 0.98)
        logit = np.full(len(patterns), np.log(share / (1 - share)))
        for good, sign in ((True, 1), (False, -1)):
            w = weight * (posterior if good else 1 - posterior)
            chance = np.einsum("vpr,p->vr", is_vote, w) + strength * prior[good][:, None] / 1.5
            chance /= chance.sum(axis=0)
            logit += sign * np.einsum("vpr,vr->p", is_vote, np.log(chance))
        fresh = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        done = np.abs(fresh - posterior).max() < 1e-9
        posterior = fresh
        if done:
            break
    right = np.where(patterns > 0, posterior[:, None], 1 - posterior[:, None]) * (patterns != 0)
    cast = np.maximum((weight[:, None] * (patterns != 0)).sum(axis=0), 1e-9)
    return posterior, np.where(cast > 1e-6, (weight[:, None] * right).sum(axis=0) / cast, 0.5)


def judge(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, the base measures, base_failed, kept, the votes' code and the posterior, for every document."""
    rules = votes()
    code = sum(((v + 1) * 3**i for i, v in enumerate(rules.values())), F.lit(0))
    base = measured(docs, "doc_id").withColumn("pattern", code.cast("int"))
    base = stored(
        base.select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "pattern"
        ),
        "rules",
    )
    rows = base.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** rules
    codes = np.array([r["pattern"] for r in rows], dtype=int)
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(rules))], axis=1) if rows else np.zeros((0, len(rules)))
    posterior, _ = fit_label_model(patterns, np.array([r["count"] for r in rows]))
    known = docs.sparkSession.createDataFrame(
        list(zip(codes.tolist(), posterior.tolist(), strict=True)), "pattern int, posterior double"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        base.join(F.broadcast(known), "pattern")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("posterior") >= keep))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "base_failed", "kept", "pattern", "posterior",
        )
    )


def op3_rules(spark, folder: str) -> DataFrame:
    return judge(table(spark, folder, "documents"))
