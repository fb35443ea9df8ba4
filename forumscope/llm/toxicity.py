"""Toxicity: a learned lexicon in a trie, met by Levenshtein automata, with the context of each hit.

The lexicon is learned from labelled training documents: words that toxic ones use far more, and word beginnings that do, for languages that
vary the ending. Every word of every text runs against the trie. A word reaches a term exactly, begins with an open term, or
comes within one edit of a whole term of five letters or more: the automaton of the word, kept as two bit masks of positions
reached with no and with one edit, walks the trie and leaves a branch as soon as both are empty. A hit between quotation marks
in its window of five words counts as quoted, apart from open abuse. A logistic model over the hits (strongest, number, share of
words; exact, begun, misspelled; quoted or not) gives the score.

Training uses at most ``FIT_ROWS`` labelled documents, the first by a hash of their ids, two thirds for the lexicon and one
for the model, and none whose crc32(doc_id) mod 4 is 2. Everything else covers all documents. The lexicon holds at most
``TERMS`` terms, the most telling ones whose use in toxic documents is no chance: by the bound of Chernoff, fewer than one of all words seen would
be taken if no word told anything. That is a bound of the model, not of the data it scores.

Defined results: a null, empty or blank text has no hits and the model's score for that; a null doc_id is never labelled and is not held
out; several labels of a document count as toxic if one is; without training labels of both kinds every score is the share of toxic
ones (0 without labels); repeated rows are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from forumscope.llm.common import map_arrow, small, stable_hash, stored, table
from forumscope.llm.sitequality import fit_logistic

FIT_ROWS = 24_000
TERMS = 4_000
MIN_TOXIC = 2
MIN_WEIGHT = 2.5
PREFIX = (4, 5, 6)
FUZZY_LETTERS = 5
WINDOW = 5
THRESHOLD = 0.3
CACHE = 300_000
HELD_OUT = 2

EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¿¡"
QUOTES = frozenset("\"«»“”„")

WHOLE, OPEN = 0, 1
EXACT, BEGUN, FUZZY = 0, 1, 2


def _without_a_letter(word: str) -> list[str]:
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


class Trie:
    """Terms by letter; a node may end a whole term, an open one (a beginning), or both, with its weight.

    The whole terms of five letters or more have a second trie, for the automata.
    """

    def __init__(self, terms: Iterable[tuple[str, int, float]]):
        self.root: dict = {}
        self.fuzzy_root: dict = {}
        self.shorter: set[str] = set()
        for term, kind, weight in sorted(terms, key=lambda t: (-t[2], t[0])):
            self._add(self.root, term, kind, weight)
            if kind == WHOLE and len(term) >= FUZZY_LETTERS:
                self._add(self.fuzzy_root, term, kind, weight)
                self.shorter |= {term, *_without_a_letter(term)}

    @staticmethod
    def _add(node: dict, term: str, kind: int, weight: float) -> None:
        for c in term:
            node = node.setdefault(c, {})
        node[kind] = weight

    def may_be_near(self, word: str) -> bool:
        """False only if no term is within one edit."""
        # one edit apart, one is the other without a letter, or both without one are equal
        return word in self.shorter or not self.shorter.isdisjoint(_without_a_letter(word))

    def exact(self, word: str) -> tuple[float, int] | None:
        """The heaviest term that the word is or begins with."""
        node, best = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            if OPEN in node and (best is None or node[OPEN] > best[0]):
                best = (node[OPEN], BEGUN)
        if WHOLE in node and (best is None or node[WHOLE] >= best[0]):
            best = (node[WHOLE], EXACT)
        return best

    def fuzzy(self, word: str) -> float | None:
        """The heaviest whole term within one edit, by walking the trie with the word's automaton."""
        size = len(word)
        if not self.may_be_near(word):
            return None
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        accept = 1 << size
        best = None
        # A state is two masks: positions of the word reached with no edit, and with at most one.
        stack = [(self.fuzzy_root, 1, 0b11, 0)]
        while stack:
            node, clean, edited, depth = stack.pop()
            if depth >= FUZZY_LETTERS and edited & accept and WHOLE in node and (best is None or node[WHOLE] > best):
                best = node[WHOLE]
            for c, child in node.items():
                if type(c) is str:
                    match = masks.get(c, 0)
                    stepped = (clean & match) << 1
                    # matched after an edit; an extra letter in the term; another letter; a letter missing in the term
                    once = (edited & match) << 1 | clean | clean << 1 | stepped | stepped << 1
                    if once := once & (2 * accept - 1):
                        stack.append((child, stepped, once, depth + 1))
        return best


class Words(dict):
    """Bounded memory of what a word, as it stands in the text, hits: weight and kind, or None."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, raw: str) -> tuple[float, int] | None:
        word = raw.strip(EDGES)
        hit = self.trie.exact(word)
        if hit is None and FUZZY_LETTERS - 1 <= len(word) <= 40:
            weight = self.trie.fuzzy(word)
            hit = None if weight is None else (weight, FUZZY)
        if len(self) >= CACHE:
            self.clear()
        self[raw] = hit
        return hit


def quoted(words: list[str], at: int) -> bool:
    """Whether quotation marks stand on both sides of a word, itself included, within the window."""
    before = any(not QUOTES.isdisjoint(w) for w in words[max(0, at - WINDOW) : at]) or words[at][0] in QUOTES
    after = any(not QUOTES.isdisjoint(w) for w in words[at + 1 : at + 1 + WINDOW]) or words[at][-1] in QUOTES
    return before and after


N_FEATURES = 14


def hit_features(text: str | None, known: Words) -> list[float]:
    """Strongest weight and log count for each kind of hit, open and quoted, and the hits' share of words."""
    words = (text or "").lower().split()
    strongest, count = [0.0] * 6, [0] * 6
    for at, raw in enumerate(words):
        hit = known[raw]
        if hit:
            place = hit[1] + 3 * quoted(words, at)
            strongest[place] = max(strongest[place], hit[0])
            count[place] += 1
    open_hits = sum(count[:3])
    share = 100 * open_hits / max(len(words), 1)
    return [w / 5 for w in strongest] + [float(np.log1p(c)) for c in count] + [min(share, 5.0), max(strongest[:3], default=0) ** 2 / 25]


def training(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """text, toxic and part (0: model, 1 and 2: lexicon) of the sample."""
    id_crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    known = labels.where("doc_id is not null and toxic is not null").where(id_crc % 4 != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = stable_hash(F.col("doc_id"))
    chosen = known.orderBy(order, "doc_id").limit(fit_rows).select(F.col("doc_id").alias("_id"), "toxic", (order % 3).alias("part"))
    return docs.select("doc_id", "text").join(small(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic", "part")


def _surprise(share: float) -> Column:
    """Minus the log of a bound on the chance that t or more of t + n documents are toxic, if a ``share`` of all is; for t above its share."""
    both = F.col("t") + F.col("n")
    part = lambda count, expected: F.when(F.col(count) > 0, F.col(count) * F.log(F.col(count) / (both * max(expected, 1e-12)))).otherwise(0.0)
    return part("t", share) + part("n", 1 - share)


def learn_lexicon(sample: DataFrame, terms: int = TERMS) -> list[tuple[str, int, float]]:
    """Terms with their kind and weight: the log of how much more often toxic documents have them."""
    sizes = sample.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n")).first()
    toxic, clean = float(sizes["t"] or 0), float(sizes["n"] or 0)
    marks = F.lit(EDGES)
    words = F.array_distinct(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.btrim(w, marks)))
    use = sample.select("toxic", F.explode(words).alias("word")).where(F.char_length("word").between(3, 40))
    seen = stored(use.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("n")), "toxic-words")
    starts = F.explode(F.array(*[F.when(F.char_length("word") > k, F.substring("word", 1, k)) for k in PREFIX]))
    begun = (
        seen.select(starts.alias("term"), "t", "n")
        .where("term is not null")
        .groupBy("term")
        .agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.count("*").alias("words"))
        .where("words > 2")
        .select("term", F.lit(OPEN).alias("kind"), "t", "n")
    )
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") + 0.5) / (clean + 1))
    told = (
        seen.select(F.col("word").alias("term"), F.lit(WHOLE).alias("kind"), "t", "n")
        .union(begun)
        .where((F.col("t") >= MIN_TOXIC) & (_surprise(toxic / max(toxic + clean, 1)) >= float(np.log(max(seen.count(), 1)))))
        .withColumn("weight", weight)
        .where(F.col("weight") >= MIN_WEIGHT)
    )
    rows = told.orderBy(F.desc("weight"), "term", "kind").limit(terms).collect()
    return [(r["term"], r["kind"], float(r["weight"])) for r in rows]


def with_hits(docs: DataFrame, terms: list[tuple[str, int, float]], *carry: str) -> DataFrame:
    fields = {f.name: f.dataType.simpleString() for f in docs.select(*carry).schema.fields}
    schema = ", ".join(f"{n} {t}" for n, t in (fields | {"x": "array<double>"}).items())

    def make():
        known = Words(Trie(terms))

        def work(batch: pa.RecordBatch) -> dict:
            x = [hit_features(t.as_py(), known) for t in batch.column("text")]
            return {c: batch.column(c) for c in carry} | {"x": x}

        return work

    return map_arrow(docs.select(*carry, *({"text"} - {*carry})), schema, make)


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and the features behind the score."""
    sample = stored(training(docs, labels, fit_rows), "toxic-sample")
    terms = learn_lexicon(sample.where("part > 0"))
    fitted = with_hits(sample.where("part = 0").select("toxic", "text"), terms, "toxic").collect()  # at most fit_rows
    y = np.array([r["toxic"] for r in fitted], dtype=float)
    if len(y) and 0 < y.mean() < 1:
        w = fit_logistic(np.array([r["x"] for r in fitted], dtype=float), y, penalty=0.2)
        odds = sum((F.col("x")[i] * float(v) for i, v in enumerate(w[:-1])), F.lit(float(w[-1])))
        chance = 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))
    else:
        chance = F.lit(float(y.mean()) if len(y) else 0.0)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))
    return with_hits(docs, terms, "doc_id").select(
        "doc_id",
        held.alias("held_out"),
        chance.alias("score"),
        F.when(chance >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        "x",
    )


def op9_toxicity(spark, folder: str) -> DataFrame:
    return score(table(spark, folder, "documents"), table(spark, folder, "labels")).drop("x")
