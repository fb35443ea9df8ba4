"""Text measures against hand-made rows and plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from forumscope.functions import text as t
from forumscope.functions.tags import distinct_tags, tag_list, tag_words
from forumscope.operators import text


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x STRING").select(*columns).first()


def fold_syllables(content):
    total = 0
    for word in content.split():
        runs = len(re.findall("[aeiouy]+", word))
        total += runs - word.endswith("e") + word.endswith("le")
        total = total or 1
    return total


def test_syllables_equal_a_running_fold(spark):
    rng = random.Random(3)
    letters = "aeiouybcdlEAé "
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))) for i in range(3000)]
    rows += [(3000, "the"), (3001, "cat the"), (3002, "table"), (3003, "Apple"), (3004, "")]
    df = spark.createDataFrame(rows, "i INT, x STRING").select("i", t.syllables(t.plain_spaces(F.col("x"))).alias("n"))
    got = {r["i"]: r["n"] for r in df.collect()}
    assert got == {i: fold_syllables(x) for i, x in rows}


def test_words_split_like_python(spark):
    value = "a\u2003b\u3000c\x1cd \x85 e\n"
    assert one(spark, value, t.words(t.plain_spaces(F.col("x"))))[0] == len(value.split()) == 5


def test_sentences(spark):
    cases = {"": 0, " \n": 0, "no stop": 1, "One. Two! Three?": 3, "Wait... what?": 2, "v1.2 is out.": 1}
    rows = spark.createDataFrame(list(cases.items()), "x STRING, n INT")
    assert rows.where(t.sentences(F.col("x")) != F.col("n")).count() == 0


def test_cleaning(spark):
    body = "<p>a<br\n>b &amp; <code>x\ny</code>c &#39;</p>"
    clean, with_code = one(spark, body, t.prose(F.col("x")), t.without_markup(F.col("x")))
    assert clean == "a<br\n>b  c "
    assert with_code == "a<br\n>b  x\nyc "


def test_code_share(spark):
    body = "<code>ab</code>text<code>c\nd</code>"
    code, share = one(
        spark, body, t.code_characters(F.col("x")), t.code_share(F.lit(5), F.lit(15))
    )
    assert (code, share) == (5, 0.25)
    assert one(spark, "none", t.code_share(t.code_characters(F.col("x")), F.lit(0)))[0] == 0.0


def test_readability_golden_and_guard(spark):
    golden, none, ease, grade = one(
        spark,
        "",
        t.coleman_liau(F.lit(11251), F.lit(3), F.lit(44)),
        t.coleman_liau(F.lit(5), F.lit(1), F.lit(0)),
        t.flesch_ease(F.lit(5), F.lit(0), F.lit(9)),
        t.flesch_grade(F.lit(30), F.lit(2), F.lit(20)),
    )
    assert golden == pytest.approx(1485.7245454545457, abs=1e-9)
    assert none == ease == -999.0
    assert grade == pytest.approx(0.39 * 10 + 11.8 * 1.5 - 15.59)


def plain_cosine(a, b):
    left, right = (Counter(re.findall(r"\w\w+", x.lower())) for x in (a, b))
    if not left or not right:
        return 0.0
    weight = {w: 1.0 if w in left and w in right else math.log(1.5) + 1 for w in {*left, *right}}
    dot = sum(left[w] * right[w] for w in left)
    norm = [math.sqrt(sum((c[w] * weight[w]) ** 2 for w in c)) for c in (left, right)]
    return dot / (norm[0] * norm[1])


def test_cosine_equals_plain_tfidf(spark):
    rng = random.Random(5)
    vocabulary = ["red", "Red", "plate", "blue", "ring", "a", "über", "x_1", "42"]
    pairs = [("red plate", "red plate"), ("red plate", "blue ring"), ("a b", "a b"), ("", "x y")]
    pairs += [
        tuple(" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) for _ in "ab") for _ in range(300)
    ]
    df = spark.createDataFrame(pairs, "a STRING, b STRING")
    for row in df.select("a", "b", t.tfidf_cosine(t.tokens(F.col("a")), t.tokens(F.col("b"))).alias("c")).collect():
        assert row["c"] == pytest.approx(plain_cosine(row["a"], row["b"]), abs=1e-12)


def test_tags(spark):
    listed, words, n = one(
        spark,
        "<c#><python-3.x><c#>",
        tag_list(F.col("x")),
        tag_words(F.col("x")),
        distinct_tags(F.col("x")),
    )
    assert (listed, words, n) == (["c#", "python-3.x", "c#"], "c# python-3.x c# ", 2)
    assert one(spark, None, tag_list(F.col("x")), distinct_tags(F.col("x"))) == (None, None)


LEXICON = [("good", 2.0), ("bad", -2.0), ("fine", 1.0)]
POSTS = "_Id BIGINT, _Body STRING, _Title STRING, _Tags STRING"


def sentiments(spark, bodies, **options):
    posts = spark.createDataFrame([(i, b, "t", "<a>") for i, b in enumerate(bodies)], POSTS)
    lexicon = spark.createDataFrame(LEXICON, "term STRING, valence DOUBLE")
    return {r["_Id"]: r["sentiment"] for r in text.sentiment(posts, lexicon, **options).collect()}


def test_sentiment_rules_and_both_join_paths(spark):
    bodies = ["good", "not good", "very bad", "it was not so very bad", "slightly fine", "nothing here", ""]
    sums = [2.0, 2.0 * -0.74, -2.293, -(2 + 0.293 + 0.293 * 0.95) * -0.74, 1 - 0.293, 0.0, 0.0]
    small, large = sentiments(spark, bodies), sentiments(spark, bodies, broadcast_bytes=0)
    for i, s in enumerate(sums):
        assert small[i] == pytest.approx(s / math.sqrt(s * s + 15))
        assert large[i] == pytest.approx(small[i])


def test_gate_needs_more_than_ten_words(spark):
    rows = [(1, "good " * 10, "good one", "<good>"), (2, "good " * 11, "good one", "<good>")]
    posts = spark.createDataFrame(rows, POSTS)
    lexicon = spark.createDataFrame(LEXICON, "term STRING, valence DOUBLE")
    got = {r["_Id"]: r for r in text.question_metrics(posts, lexicon).collect()}
    assert all(got[1][m] == 0.0 for m in text.METRICS)
    assert got[2]["sentiment"] > 0.9 and got[2]["cos_sim_title_tag"] > 0


def rows_sent(made):
    """Rows of a made table, and rows that went through its shuffles."""
    found = made.collect()
    todo, sent = [made._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                sent += node.metrics().apply("shuffleRecordsWritten").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return found, sent


def test_used_words_of_a_large_lexicon_are_not_shuffled(spark):
    """A lexicon over the limit: words in many texts meet it by broadcast, rare ones by shuffle, once for a text; results are those of a broadcast."""
    rng = random.Random(7)
    common = ["good", "bad", "very", "not", *[f"word{i}" for i in range(40)]]
    rows = []
    for i in range(400):
        words = rng.choices(common, k=200) + ["not", f"rare{i}", "so", f"rare{i}", f"lost{i}"]
        rows.append((i, " ".join(words), "good words", "<a>"))
    rows += [(400, "", None, None), (401, None, "t", "<a>"), (3, "good " * 12, "t", "<a>")]  # one id comes twice
    posts = spark.createDataFrame(rows, POSTS).repartition(4)
    terms = [*LEXICON, *[(f"word{i}", i / 40 - 0.5) for i in range(0, 40, 2)], *[(f"rare{i}", (-1.0) ** i) for i in range(4000)]]
    lexicon = spark.createDataFrame(terms, "term STRING, valence DOUBLE")
    whole = {r["_Id"]: r["sentiment"] for r in text.sentiment(posts, lexicon).collect()}
    for limit, most in ((20_000, 12_000), (0, 200_000)):
        found, sent = rows_sent(text.sentiment(posts, lexicon, limit))
        assert len(found) == len(whole) == 402 and sent < most
        for r in found:
            assert r["sentiment"] == pytest.approx(whole[r["_Id"]], abs=1e-12)
    assert whole[400] == whole[401] == 0.0 and whole[5] != whole[6]


def test_measures_sort_without_a_lambda_and_match_once(spark):
    """Words are sorted by their own order, not by a comparing lambda; syllables take one pass over the text and one over its first word."""
    texts = spark.createDataFrame([("a table here", "the table")], "x STRING, y STRING")
    made = texts.select(t.tfidf_cosine(t.tokens(F.col("x")), t.tokens(F.col("y"))).alias("c"), t.syllables(F.col("x")).alias("s"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(" not in plan and plan.count("regexp_extract_all(") <= 2 + 2
    assert made.first()["s"] == 4


def test_syllables_of_ends_in_e(spark):
    words = ["e", "le", "ee", "lee", "ae", "ale", "eel", "toe", "bee.", "be!", "le le", "e e", "tie", "yle", "ele", "lele ae", "é e"]
    rows = spark.createDataFrame([(w,) for w in words], "x STRING").select("x", t.syllables(F.col("x")).alias("n"))
    for r in rows.collect():
        assert r["n"] == fold_syllables(r["x"]), r["x"]


def test_words_looked_up_first_fit_the_limit(spark):
    """As many of the most used words as fit, also those without a valence; none if none fits."""
    rows = [(i, ["often", "unlisted", f"once{i}"]) for i in range(4000)]
    listed = spark.createDataFrame(rows, "_Id BIGINT, terms ARRAY<STRING>").repartition(3)
    lexicon = spark.createDataFrame([("often", 1.0), *[(f"once{i}", 0.5) for i in range(4000)]], "term STRING, valence DOUBLE")
    few = {r["term"]: r["valence"] for r in text.frequent_words(listed, "_Id", lexicon, 1000).collect()}
    assert few == {"often": 1.0, "unlisted": None}
    every = text.frequent_words(listed, "_Id", lexicon, 1 << 20)
    assert 100 < every.count() < 600 and text.frequent_words(listed, "_Id", lexicon, 0).count() == 0
