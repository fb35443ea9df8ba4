"""Text measures of a post as JVM-side column expressions.

Everything works on the whole text with the built-in regex and array functions, so a scan with these
columns has no Python stage and no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# What counts as code, markup, a sentence end, a cosine token and white space.
CODE_SPAN = r"(?s)<code>.*?</code>"
MARKUP = r"(?d)<.*?>|&([a-z0-9]+|#[0-9]{1,6}|#x[0-9a-f]{1,6});"
SENTENCE_END = r"[.!?]+(?:\s|\z)"
TOKEN = r"[\p{L}\p{N}_]{2,}"
WORD = r"\S+"
RARE_SPACES = "".join(
    map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# A vowel run whose last letter is not a final e, or is one behind an l.
VOICED_RUN = r"[aeiouy]++(?:(?<!e)|(?<=le)|(?=\S))"

# Coefficients of the published readability formulas, and the no-text marker.
COLEMAN_LIAU = (0.0588, 0.296, 15.8)
FLESCH_EASE = (206.835, 1.015, 84.6)
FLESCH_GRADE = (0.39, 11.8, 15.59)
NO_TEXT = -999.0

# Smoothed inverse document frequency of a term found in one of two texts; found in both it is 1.
ONE_SIDED_IDF = math.log(3 / 2) + 1


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def without_markup(body: Column) -> Column:
    """Text with tags and entities removed; code stays."""
    return F.regexp_replace(F.coalesce(body, F.lit("")), MARKUP, "")


def prose(body: Column) -> Column:
    """Text with code spans, tags and entities removed."""
    return without_markup(F.regexp_replace(F.coalesce(body, F.lit("")), CODE_SPAN, ""))


def plain_spaces(text: Column) -> Column:
    """The text with every kind of white space outside ASCII blanks as a blank; same length.

    The counts below expect this form: short patterns run several times faster than wide classes.
    """
    return F.translate(text, RARE_SPACES, " " * len(RARE_SPACES))


def words(text: Column) -> Column:
    return count_matches(text, WORD)


def sentences(text: Column) -> Column:
    """Sentence ends, and at least one sentence when there is any word."""
    ends = count_matches(text, SENTENCE_END)
    return F.when(text.rlike(WORD), F.greatest(ends, F.lit(1))).otherwise(F.lit(0))


def syllables(text: Column) -> Column:
    """Vowel runs, less one for a final ``e`` unless the word ends in ``le``, over all words.

    A run cannot cross white space, so counting over the whole text equals the sum over its words.
    The running total is floored at one after the first word only: no word lowers it.
    """

    first_word = F.regexp_extract(text, WORD, 0)
    silent_start = (F.length(first_word) > 0) & (count_matches(first_word, VOICED_RUN) == 0)
    return count_matches(text, VOICED_RUN) + F.when(silent_start, 1).otherwise(0)


def coleman_liau(characters: Column, n_sentences: Column, n_words: Column) -> Column:
    a, b, c = COLEMAN_LIAU
    letters = F.try_divide(characters.cast("double"), n_words) * 100
    stops = F.try_divide(n_sentences.cast("double"), n_words) * 100
    return F.coalesce(a * letters - b * stops - c, F.lit(NO_TEXT))


def flesch_ease(n_syllables: Column, n_sentences: Column, n_words: Column) -> Column:
    a, b, c = FLESCH_EASE
    length, weight = _pace(n_syllables, n_sentences, n_words)
    return F.coalesce(a - b * length - c * weight, F.lit(NO_TEXT))


def flesch_grade(n_syllables: Column, n_sentences: Column, n_words: Column) -> Column:
    a, b, c = FLESCH_GRADE
    length, weight = _pace(n_syllables, n_sentences, n_words)
    return F.coalesce(a * length + b * weight - c, F.lit(NO_TEXT))


def _pace(n_syllables: Column, n_sentences: Column, n_words: Column) -> tuple[Column, Column]:
    """Words to a sentence and syllables to a word; null where either count is zero."""
    return (
        F.try_divide(n_words.cast("double"), n_sentences),
        F.try_divide(n_syllables.cast("double"), n_words),
    )


def code_characters(body: Column) -> Column:
    """Characters inside code spans, without the tags themselves."""
    spans = F.array_join(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(CODE_SPAN), 0), "")
    opened = F.replace(spans, F.lit("<code>"), F.lit(""))
    return F.length(F.replace(opened, F.lit("</code>"), F.lit("")))


def code_share(code_length: Column, text_length: Column) -> Column:
    return F.coalesce(F.try_divide(code_length.cast("double"), text_length + code_length), F.lit(0.0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


# A mark below every character of a token: a term's marked uses sort right behind its plain ones.
MARK = "!"


def tfidf_cosine(short: Column, long: Column) -> Column:
    """Cosine of two token lists under smoothed TF-IDF with the pair as the whole corpus.

    The tokens of the short side get a mark, the others stay as they are, and all are sorted as plain strings and folded by run
    length. A term is closed when another one starts, so the state is one term, its two counts and three sums whatever the
    length of the texts.
    """

    def close(state: Column) -> tuple[Column, Column, Column]:
        l, r = state["l"], state["r"]
        square = F.when((l > 0) & (r > 0), F.lit(1.0)).otherwise(F.lit(ONE_SIDED_IDF**2))
        return (
            (state["dot"] + l * r).alias("dot"),
            (state["ll"] + l * l * square).alias("ll"),
            (state["rr"] + r * r * square).alias("rr"),
        )

    def state_of(state: Column, l: Column, r: Column) -> Column:
        return F.struct(state["t"].alias("t"), l.alias("l"), r.alias("r"), *[state[n].alias(n) for n in ("dot", "ll", "rr")])

    def step(state: Column, item: Column) -> Column:
        marked = F.endswith(item, F.lit(MARK))
        plain = F.when(marked, F.left(item, F.length(item) - 1)).otherwise(item)
        counts = (F.when(marked, 1.0).otherwise(0.0).alias("l"), F.when(marked, 0.0).otherwise(1.0).alias("r"))
        one_sided = state["rr"] + state["r"] * state["r"] * F.lit(ONE_SIDED_IDF**2)
        # Nearly all steps are of the first two kinds; the second is the last one without its zeros.
        return (
            F.when(item == state["t"], state_of(state, state["l"], state["r"] + 1.0))
            .when(
                ~marked & (state["l"] == 0.0),
                F.struct(
                    item.alias("t"), F.lit(0.0).alias("l"), F.lit(1.0).alias("r"), state["dot"].alias("dot"), state["ll"].alias("ll"), one_sided.alias("rr")
                ),
            )
            .when(item == F.concat(state["t"], F.lit(MARK)), state_of(state, state["l"] + 1.0, state["r"]))
            .otherwise(F.struct(plain.alias("t"), *counts, *close(state)))
        )

    def finish(state: Column) -> Column:
        dot, ll, rr = close(state)
        return F.coalesce(F.try_divide(dot, F.sqrt(ll) * F.sqrt(rr)), F.lit(0.0))

    empty = F.struct(F.lit("").alias("t"), *[F.lit(0.0).alias(name) for name in ("l", "r", "dot", "ll", "rr")])
    together = F.concat(long, F.transform(short, lambda t: F.concat(t, F.lit(MARK))))
    return F.aggregate(F.sort_array(together), empty, step, finish)
