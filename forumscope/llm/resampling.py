"""Importance resampling towards a target distribution, over hashed word features.

A pre-tokeniser that needs no training (one regex split) gives every text's words with their offsets. A feature is a run of one to
``longest`` words: a pair of the first word's start and the last word's end, cut out of the text with single spaces. Its CRC modulo
``buckets`` is its bucket. A bucket's gain is the smoothed log ratio of its share in the target table and its share in all documents; a document's
weight is the mean gain of its features, and Gumbel noise from a hash of its id turns weights into a draw without replacement: the
documents with the highest sums are drawn.

Texts are tokenised once. Each row keeps its buckets as a packed number array in a stored table, from which every task counts a
histogram of at most ``buckets`` rows (the only thing that is shuffled) and, once the gains are known, sums them. The gains are
``buckets`` numbers on the driver and in every task, a bound set by that parameter. Ranks need no global sort: rows are counted by score, counts are
summed from the top first over blocks of scores and then inside each block, and only the rows of scores that reach into the draw are numbered, each
score by itself. Noise spreads the rows of any text over thousands of scores.

Defined results: a null, empty or wordless text has no features and weight 0; texts are whole whatever their length; equal
scores rank by doc_id, without one last, then by text; repeated rows are a row each, with equal scores and consecutive ranks; a null doc_id is hashed as
the word ``null``; an empty table gives an empty result, an empty target the smoothed gains of an empty histogram; other columns are ignored, so any name may
stand beside ``doc_id`` and ``text``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from forumscope.llm.common import map_arrow, small, stored, table

# Fixed values of the contract: what a word is, the buckets, the noise's seed, and who takes part in the draw.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONGEST = 1
BUCKETS = 10_000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10

SCALE = 1000
CACHED = 1 << 20  # features whose bucket a task remembers
BLOCK = 1024  # neighbouring scores that are counted together


def splitter():
    """A regex split that keeps the matches: text to (word, (start, end)), without a vocabulary."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True).pre_tokenize_str


def packed_as(buckets: int) -> str:
    """The number type of a stored bucket."""
    return "<u2" if buckets <= 1 << 16 else "<u4"


class FeatureBuckets:
    """Words and feature buckets of texts."""

    def __init__(self, longest: int = LONGEST, buckets: int = BUCKETS):
        self.longest, self.buckets = longest, buckets
        self.split = splitter()
        self.known: dict[str, int] = {}

    def bucket(self, feature: str) -> int:
        found = self.known.get(feature)
        if found is None:
            found = zlib.crc32(feature.encode()) % self.buckets
            if len(self.known) < CACHED:
                self.known[feature] = found
        return found

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """The number of words, and the bucket of each feature: all runs of one word, then of two, and so on."""
        words = self.split((text or "").encode().lower().decode())  # bytes are lowered in ASCII only
        found = [self.bucket(word) for word, _ in words]
        if self.longest > 1:
            spaced = " ".join(word for word, _ in words)
            ends = np.cumsum([len(word) + 1 for word, _ in words]).tolist()
            starts = [0, *ends[:-1]]
            for run in range(2, self.longest + 1):
                found += [self.bucket(spaced[s : e - 1]) for s, e in zip(starts, ends[run - 1 :])]
        return len(words), np.array(found, dtype=packed_as(self.buckets))


def bucketed(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, a hash of the row, n_words, n_features and the packed buckets of every text."""
    kind = texts.select("doc_id").schema[0].dataType.simpleString()

    def make():
        features = FeatureBuckets(longest, buckets)

        def work(batch: pa.RecordBatch) -> dict:
            made = [features.of(t.as_py()) for t in batch.column("text")]
            return {
                "doc_id": batch.column("doc_id"),
                "tie": batch.column("tie"),
                "n_words": [n for n, _ in made],
                "n_features": [len(b) for _, b in made],
                "buckets": [b.tobytes() for _, b in made],
            }

        return work

    rows = texts.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    return map_arrow(rows, f"doc_id {kind}, tie bigint, n_words bigint, n_features bigint, buckets binary", make)


def histogram(made: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, the number of features in it, over all rows."""
    kind = packed_as(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for packed in batch.column("buckets"):
                total += np.bincount(np.frombuffer(packed.as_py(), kind), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    partial = made.select("buckets").mapInArrow(count, "bucket bigint, n bigint")
    return partial.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The gain of every bucket (bucket, gain), from the two histograms."""
    every = documents.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    left = documents.select("bucket", F.col("n").alias("s"))
    right = target.select("bucket", F.col("n").alias("t"))
    both = every.join(left, "bucket", "left").join(right, "bucket", "left").na.fill(0, ["s", "t"])
    all_s, all_t = (float(x) for x in both.agg(F.sum("s"), F.sum("t")).first())
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = ((t + 1) * F.lit(all_s + buckets)) / ((s + 1) * F.lit(all_t + buckets))
    return both.select("bucket", F.floor(F.lit(float(SCALE)) * F.log(ratio)).cast("bigint").alias("gain"))


def weighed(made: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, tie, n_words, n_features and weight, the floored mean gain of a row's features."""
    kind = made.select("doc_id").schema[0].dataType.simpleString()
    stored_as = packed_as(len(gain))
    kept = ("doc_id", "tie", "n_words", "n_features")

    def make():
        def weight(packed: bytes) -> int:
            found = np.frombuffer(packed, stored_as)
            return int(gain[found].sum()) // len(found) if len(found) else 0

        def work(batch: pa.RecordBatch) -> dict:
            return {c: batch.column(c) for c in kept} | {"weight": [weight(b.as_py()) for b in batch.column("buckets")]}

        return work

    return map_arrow(made, f"doc_id {kind}, tie bigint, n_words bigint, n_features bigint, weight bigint", make)


def noisy(weight: Column, seed: str = SEED) -> Column:
    """The weight plus Gumbel noise from the row's id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.lit(-float(SCALE)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))
    return weight + F.floor(noise)


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows with their rank in the draw, null if undrawn. ``scored``: doc_id, tie, n_words, score and any others."""
    takes_part = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    per = scored.where(takes_part).groupBy("score").agg(F.count("*").alias("n"))
    per = stored(per.withColumn("block", F.floor(F.col("score") / BLOCK)), "resample-scores")
    size = percent * (per.agg(F.sum("n")).first()[0] or 0) // 100
    above = Window.rowsBetween(Window.unboundedPreceding, -1)
    blocks = per.groupBy("block").agg(F.sum("n").alias("_n"))  # a few dozen rows whatever the table
    blocks = blocks.select("block", F.coalesce(F.sum("_n").over(above.orderBy(F.desc("block"))), F.lit(0)).alias("_blocks"))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    starts = per.join(F.broadcast(blocks), "block").select("score", (F.col("_blocks") + F.coalesce(inside, F.lit(0))).alias("_before"))
    starts = stored(starts.where(F.col("_before") < size).select(F.col("score").alias("_score"), "_before"), "resample-starts")
    reach = scored.join(small(starts), takes_part & (F.col("score") == F.col("_score")), "left")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "tie")
    rank = F.col("_before") + F.row_number().over(order)
    ranked = reach.where("_before is not null").withColumn("rank", F.when(rank <= size, rank))
    rest = reach.where("_before is null").withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).drop("_score", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, tie (a hash of the text), n_words, n_features, weight, score and rank of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text)."""
    made = stored(bucketed(docs, longest, buckets), "resample-buckets")
    aim = bucketed(target.select(F.lit(0).alias("doc_id"), "text"), longest, buckets)
    gain = np.zeros(buckets, dtype=np.int64)
    for row in gains(histogram(made, buckets), histogram(aim, buckets), buckets).collect():
        gain[row["bucket"]] = row["gain"]
    scored = weighed(made, gain).withColumn("score", noisy(F.col("weight"), seed))
    return drawn(stored(scored, "resample-scored"), percent, least_words)


def op11_resample(spark, folder: str) -> DataFrame:
    found = resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def sql_crc32(text: str) -> str:
    """Unsigned CRC-32 of an expression's UTF-8 bytes in DuckDB; the byte table is made by its rule."""
    table256 = (
        "list_transform(range(256), lambda n: list_reduce(list_concat([n::BIGINT], range(8)), "
        "lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    )
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    folded = f"list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, ({table256})[(xor(c, b) & 255) + 1]))"
    return f"xor({folded}, 4294967295)"


OP11_SQL = rf"""
WITH texts AS (
  SELECT doc_id, 'd' AS side, text FROM documents UNION ALL SELECT item_id, 'b', text FROM benchmark
), words AS (
  SELECT doc_id, side, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')) AS word FROM texts
), used AS (SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY ALL
), buckets AS (SELECT word, {sql_crc32("word")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM used)
), counts AS (
  SELECT bucket, sum(CASE WHEN side = 'd' THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN side = 'b' THEN n ELSE 0 END)::DOUBLE AS t
  FROM used JOIN buckets USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor({SCALE}.0::DOUBLE * ln(((t + 1) * ((SELECT sum(s) FROM counts) + {BUCKETS}))
    / ((s + 1) * ((SELECT sum(t) FROM counts) + {BUCKETS}))))::BIGINT AS gain FROM counts
), sums AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight
  FROM used JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-{SCALE}.0::DOUBLE
    * ln(-ln((('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN sums USING (doc_id)
), ordered AS (
  SELECT *, CASE WHEN n_features >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) END AS place
  FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM scored WHERE n_features >= {LEAST_WORDS}) // 100 THEN place END AS rank
FROM ordered
"""
