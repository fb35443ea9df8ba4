"""Text measures of posts, one narrow row for each post."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from forumscope.functions import text as t
from forumscope.functions.tags import tag_words
from forumscope.operators.joins import BROADCAST_BYTES, ROW_BYTES, fits_broadcast
from forumscope.session import shared_folder

# Fixed value: a text needs more words than this to be measured.
GATE_WORDS = 10

METRICS = (
    "Flesch_Kincard_Grade",
    "Flesch_reading_ease",
    "Coleman_Liau_index",
    "code_percentage",
    "cos_sim_post_title",
    "cos_sim_title_tag",
    "sentiment",
)

# One text in so many is counted to find the words that are looked up first.
COUNTED_TEXTS = 16

# Constants of the published lexicon rule for compound sentiment.
BOOST = 0.293
NEGATED = -0.74
NORMALISER = 15.0
FADE = (1.0, 0.95, 0.9)
# The second line is what the token rule leaves of contractions such as isn't.
NEGATIONS = (
    "cannot", "neither", "never", "no", "nobody", "none", "nor", "not", "nothing", "nowhere", "without",
    "ain", "aren", "couldn", "didn", "doesn", "don", "hadn", "hasn", "haven", "isn", "mightn", "mustn", "needn", "shan",
    "shouldn", "wasn", "weren", "won", "wouldn",
)
AMPLIFIERS = ("absolutely", "completely", "especially", "extremely", "highly", "really", "so", "totally", "very")
DAMPENERS = ("barely", "hardly", "marginally", "partly", "scarcely", "slightly", "somewhat")


def cleaned_text(posts: DataFrame, keep_code: bool = False) -> DataFrame:
    clean = t.without_markup if keep_code else t.prose
    return posts.select("_Id", clean(F.col("_Body")).alias("text"))


def text_counts(posts: DataFrame) -> DataFrame:
    """Words, characters, sentences and syllables of the cleaned body."""
    text = F.col("text")
    return cleaned_text(posts).withColumn("text", t.plain_spaces(text)).select(
        "_Id",
        t.words(text).alias("words"),
        F.length(text).alias("characters"),
        t.sentences(text).alias("sentences"),
        t.syllables(text).alias("syllables"),
    )


def readability(posts: DataFrame) -> DataFrame:
    """The three readability indices of every post, with the marker value for empty text."""
    w, c, s, y = (F.col(x) for x in ("words", "characters", "sentences", "syllables"))
    return text_counts(posts).select(
        "_Id",
        t.flesch_grade(y, s, w).alias("Flesch_Kincard_Grade"),
        t.flesch_ease(y, s, w).alias("Flesch_reading_ease"),
        t.coleman_liau(c, s, w).alias("Coleman_Liau_index"),
    )


def code_shares(posts: DataFrame) -> DataFrame:
    body = F.col("_Body")
    measured = posts.select(
        "_Id", t.code_characters(body).alias("code_chars"), F.length(t.prose(body)).alias("text_chars")
    )
    share = t.code_share(F.col("code_chars"), F.col("text_chars"))
    return measured.withColumn("code_percentage", share)


def title_cosines(posts: DataFrame, other: str) -> DataFrame:
    """Similarity of each title with its ``post`` text or its ``tags``."""
    sides = {
        "post": (t.prose(F.col("_Body")), "cos_sim_post_title"),
        "tags": (tag_words(F.coalesce(F.col("_Tags"), F.lit(""))), "cos_sim_title_tag"),
    }
    text, name = sides[other]
    return posts.select("_Id", t.tfidf_cosine(t.tokens(t.prose(F.col("_Title"))), t.tokens(text)).alias(name))


def sentiment(posts: DataFrame, lexicon: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Compound sentiment of every post, zero where no word has a valence."""
    listed = cleaned_text(posts).select("_Id", t.tokens(F.col("text")).alias("terms"))
    return with_sentiment(listed, ["_Id"], [], lexicon, broadcast_bytes)


def with_sentiment(
    listed: DataFrame, keys: Sequence[str], measures: Sequence[str], lexicon: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``keys`` and ``measures`` of every row with its compound sentiment in -1..1. ``listed``: these and ``terms``, the words in order.

    Up to three words before a valenced word can strengthen, weaken or negate it. One generator gives a row's words, each with its three predecessors,
    and a marker, which alone has the measures and joins with nothing; one grouping, combined in the task that read the row, closes both. So texts are read once,
    and a row without a valenced word is not lost. ``keys`` have to tell rows apart.

    A lexicon that does not fit a broadcast is looked up in two steps: the most used words by broadcast (``frequent_words``), and only the others, once for a
    row and word, by shuffle. No word that is left is in many rows, so no task gets a large part of them.
    """
    before = [F.concat(F.array_repeat(F.lit(""), d), "terms").alias(f"back{d}") for d in (1, 2, 3)]
    zipped = F.inline(F.arrays_zip(F.col("terms").alias("term"), "back1", "back2", "back3"))
    placed = listed.select(*keys, *measures, "terms", *before).select(*keys, *measures, zipped)
    marker = F.col("back2").isNull()  # the last of the three places behind the words
    push, negated = F.lit(0.0), F.lit(False)
    for distance, fade in zip((1, 2, 3), FADE):
        word = F.col(f"back{distance}")
        push = (
            push
            + F.when(word.isin(*AMPLIFIERS), BOOST * fade)
            .when(word.isin(*DAMPENERS), -BOOST * fade)
            .otherwise(0.0)
        )
        negated = negated | word.isin(*NEGATIONS)
    flagged = placed.where(F.col("term").isNotNull() | marker).select(
        *keys,
        *[F.when(marker, F.col(m)).alias(m) for m in measures],
        "term",
        marker.alias("marker"),
        push.alias("push"),
        F.when(negated, NEGATED).otherwise(1.0).alias("turn"),
    )
    lexicon = lexicon.select("term", "valence")
    closed = [F.max(m).alias(m) for m in measures]
    moved = (F.col("valence") + F.signum("valence") * F.col("push")) * F.col("turn")
    if fits_broadcast(lexicon, broadcast_bytes):
        looked = flagged.join(F.broadcast(lexicon), "term", "left")
        found = looked.where(F.col("marker") | F.col("valence").isNotNull()).withColumn("moved", moved)
    else:
        known = frequent_words(listed, keys[0], lexicon, broadcast_bytes).withColumn("known", F.lit(True))
        looked = flagged.join(F.broadcast(known), "term", "left")
        rest = F.when(F.col("known").isNull(), F.col("term"))
        rare = looked.groupBy(*keys, rest.alias("term")).agg(
            *closed,
            F.sum(moved).alias("sure"),
            F.sum("turn").alias("turn"),
            F.sum(F.col("push") * F.col("turn")).alias("push"),
        )
        # A row without a rare word gets a key of its own, so that these rows do not meet in one partition.
        own = F.coalesce(F.col("term"), F.concat_ws("|", F.lit("\u0001"), *keys))
        valued = rare.withColumn("term", own).join(lexicon, "term", "left")
        later = F.col("valence") * F.col("turn") + F.signum("valence") * F.col("push")
        found = valued.withColumn("moved", F.coalesce("sure", later))
    sums = found.groupBy(*keys).agg(*closed, F.sum("moved").alias("s"))
    compound = F.col("s") / F.sqrt(F.col("s") * F.col("s") + NORMALISER)
    return sums.select(*keys, *measures, F.coalesce(compound, F.lit(0.0)).alias("sentiment"))


def frequent_words(listed: DataFrame, key: str, lexicon: DataFrame, limit: int) -> DataFrame:
    """The most used words of the texts, as many as a broadcast of ``limit`` bytes holds, with their valence or null.

    Uses are counted in one text of ``COUNTED_TEXTS``, by a hash of the key. This only says which way a word is looked up, never whether, so no
    result depends on it. Words go by classes of about equal use; at most some 250 sums reach the driver.
    """
    shared_folder(listed.sparkSession)
    counted = listed.where(F.pmod(F.xxhash64(key), F.lit(COUNTED_TEXTS)) == 0)
    uses = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    classed = uses.select("term", F.floor(F.log2("n") * 4).cast("int").alias("class"))
    words = classed.join(lexicon, "term", "left").checkpoint()
    width = F.octet_length("term") + (16 + 8 + 8 + ROW_BYTES)
    sizes = words.groupBy("class").agg(F.sum(width.cast("bigint")).alias("bytes")).orderBy(F.desc("class")).collect()
    taken, lowest = 0, None
    for row in sizes:
        taken += row["bytes"]
        if taken > limit:
            break
        lowest = row["class"]
    least = F.lit(False) if lowest is None else F.col("class") >= lowest
    return words.where(least).select("term", "valence")


def question_metrics(posts: DataFrame, lexicon: DataFrame | None, carry: Sequence[str] = ()) -> DataFrame:
    """The seven text metrics of each question, zero for texts of ten words or fewer; six without a lexicon.

    Bodies are read and cleaned once and never leave the scan: the words of a text and one row of its measures come out of
    it together, and only ids and numbers are shuffled.
    """
    body = F.col("_Body")
    texts = posts.select(
        "_Id",
        *carry,
        t.prose(body).alias("clean"),
        t.tokens(t.prose(F.col("_Title"))).alias("title"),
        t.tokens(tag_words(F.coalesce(F.col("_Tags"), F.lit("")))).alias("tags"),
        t.code_characters(body).alias("code"),
    )
    texts = texts.select(
        "_Id", *carry, "title", "tags", "code", t.plain_spaces(F.col("clean")).alias("text"), t.tokens(F.col("clean")).alias("terms")
    )
    text = F.col("text")
    counted = texts.select(
        "_Id",
        *carry,
        "code",
        "terms",
        t.words(text).alias("w"),
        F.length(text).alias("c"),
        t.sentences(text).alias("s"),
        t.syllables(text).alias("y"),
        t.tfidf_cosine(F.col("title"), F.col("terms")).alias("with_post"),
        t.tfidf_cosine(F.col("tags"), F.col("title")).alias("with_tags"),
    )
    w, c, s, y = (F.col(x) for x in "wcsy")
    values = (
        t.flesch_grade(y, s, w),
        t.flesch_ease(y, s, w),
        t.coleman_liau(c, s, w),
        t.code_share(F.col("code"), c),
        F.col("with_post"),
        F.col("with_tags"),
    )
    measured = counted.select(
        "_Id",
        *carry,
        "terms",
        (w > GATE_WORDS).alias("long_enough"),
        *[_gated(w > GATE_WORDS, v).alias(name) for name, v in zip(METRICS, values)],
    )
    if lexicon is None:
        return measured.drop("terms", "long_enough")
    found = with_sentiment(measured, ["_Id", *carry], ["long_enough", *METRICS[:-1]], lexicon)
    return found.withColumn("sentiment", _gated(F.col("long_enough"), F.col("sentiment"))).drop("long_enough")


def _gated(passes: Column, value: Column) -> Column:
    return F.when(passes, value).otherwise(F.lit(0.0))
