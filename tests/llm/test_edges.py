"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from forumscope.llm import linededup, mixing, neighbours, packing, pii, rules, simhash, sitequality, suffixes, toxicity

WORDS = "the river ran under an old stone bridge while seven quiet people watched it from above"
LONG = " ".join(f"{w}{i}" for i in range(3000) for w in ("alpha", "beta")) + "\n" + "x" * 5000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `_row` int, node string, size int, kept int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 2, 3) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    text = "\n".join([WORDS, "second line of words that goes on for a while", WORDS])
    return documents(
        spark,
        [
            (1, text, "en", "a", 10),
            (1, text, "en", "a", 10),
            (2, text, "en", None, 10),
            (3, None, "en", "a", None),
            (4, "", None, "b", 0),
            (5, "\n \t\r\n", "de", None, 5),
            (None, WORDS, "fr", "b", 9),
            (6, LONG, "en", "b", len(LONG)),
            (7, "ö" * 300 + " ß", "de", "c", 302),
        ],
    )


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (1, 1, 0), (3, 0, None), (None, 1, 1), (6, 1, 0), (4, 0, 1), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


PER_ROW = {
    "rules": lambda docs, labels: rules.judge(docs),
    "pii": lambda docs, labels: pii.find(docs),
    "simhash": lambda docs, labels: simhash.groups(docs),
    "quality": lambda docs, labels: sitequality.posteriors(docs, labels),
    "suffixes": lambda docs, labels: suffixes.remove(docs),
    "toxicity": lambda docs, labels: toxicity.score(docs, labels),
    "mixing": lambda docs, labels: mixing.plan_mix(docs),
    "lines": lambda docs, labels: linededup.without_repeats(docs),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_a_row_for_every_row(name, odd, empty, labels):
    made = PER_ROW[name](odd, labels).collect()
    assert len(made) == 9
    assert PER_ROW[name](empty, labels).count() == 0
    assert PER_ROW[name](odd, labels.where("false")).count() == 9


STAGES = {name: stage for name, stage in corpus_pipeline.STAGES}


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages_keep_columns(name, spark, odd, empty, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, empty):
        made = STAGES[name](spark, docs, str(tmp_path))
        assert made.dtypes == docs.dtypes
        made.collect()


def test_packing_covers_every_row(odd, empty):
    made = packing.pack(odd, with_ids=False)
    totals = made.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("one")).collect()
    assert {r["doc_id"] for r in totals} == {1, 2, 3, 4, 5, 6, 7, None}
    assert {r["doc_id"]: r["n"] / r["one"] for r in totals} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 1}
    assert {r["doc_id"]: r["one"] for r in totals}[3] == 1
    assert packing.pack(empty).count() == 0


def test_repeated_rows_are_near_copies(spark, odd):
    kept = simhash.keep_one(odd)
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == ["1", "3", "6", "7", "None"]  # 2 copies 1; 4 and 5 are empty as 3


def test_lines_of_repeated_rows(odd):
    made = {(r["_row"]["doc_id"], r["_n_lines"], r["_n_removed"]) for r in linededup.without_repeats(odd).collect()}
    assert (2, 3, 3) in made and (3, 0, 0) in made and (4, 1, 0) in made
    assert (None, 1, 0) in made  # a null id is the first of all
    assert (1, 3, 2) in made


def test_lines_of_rows_that_share_an_id(spark):
    same = "a line that several of the rows have as their second one"
    others = ["quick brown foxes jump", "lazy dogs sleep all day", "seven ships left the port"]
    for doc_id in (None, 1):
        rows = [(doc_id, f"{first} at once\n{second}\n{first[::-1]}", "en", "a", 9) for first, second in zip(others, (same, same, "wholly different words stand here now"))]
        made = {r["_text"] for r in linededup.without_repeats(documents(spark, rows)).select("_text").collect()}
        assert rows[2][1] in made  # its second line is no repeat
        assert sum(same in text for text in made) == 1
        assert all(f"{first} at once" in "".join(made) and first[::-1] in "".join(made) for first in others)


def test_near_dedup_of_rows_that_share_an_id(spark):
    texts = [WORDS, "a wholly different text about ships that leave the port at night", "nothing of that but seven dogs asleep in the sun", WORDS]
    for doc_id in (None, 1):
        rows = [(doc_id, text, "en", "a", 9) for text in texts]
        assert sorted(r["text"] for r in simhash.keep_one(documents(spark, rows)).collect()) == sorted(set(texts))


def test_quality_of_rows_that_share_an_id(spark):
    good = [" ".join([WORDS, "and the man said that it was one of the best days of the year", str(i)]) for i in range(30)]
    bad = [f"$$$ ### !!! {i} @@@ $$$ %%% ###" for i in range(30)]
    rows = [(i, text, "en", "a", 9) for i, text in enumerate(good[:20] + bad[:20])]
    known = spark.createDataFrame([(i, int(i < 20), 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    for doc_id in (None, 99):
        docs = documents(spark, rows + [(doc_id, text, "en", "a", 9) for text in good[20:] + bad[20:]])
        kept = {r["text"] for r in sitequality.keep_good(docs, known).collect()}
        assert set(good) <= kept and kept.isdisjoint(bad)


def test_vectors(spark):
    good = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)]
    bad = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [1.0, float("inf"), 0.0]), (105, []), (106, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    rows = spark.createDataFrame([(*r, 5) for r in good + bad + good[:3]], "id bigint, vec array<float>, node int")
    made = neighbours.nearest(rows, F.col("id") % 20 == 0).collect()
    best = {}
    for q in (0, 20, 40):
        dots = [(-sum(a * b for a, b in zip(dict(good)[q], v)), i) for i, v in good if i != q]
        best[q] = [i for _, i in sorted(dots)[:20]]
    for q in best:
        got = [r["vec_id"] for r in sorted((r for r in made if r["query_id"] == q), key=lambda r: r["rank"])]
        assert got == best[q]
    assert {r["query_id"] for r in made} == {0, 20, 40}
    few = neighbours.nearest(rows.where("id < 3"), F.col("id") % 20 == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert neighbours.nearest(rows.where("false"), F.col("id") % 20 == 0).count() == 0


def test_mix_of_nothing_and_of_odd_rows(spark):
    """No rows give no shards; null, empty and repeated rows are dealt like any others, with their other columns."""
    schema = "doc_id bigint, source string, text string, _block int, _shard string, shard int"
    none = spark.createDataFrame([], schema)
    assert mixing.mix(none).count() == 0 and mixing.plan_mix(none).count() == 0
    rows = [(1, None, "a b c", 7, "x", 1), (None, "s", "d e", 8, "y", 2), (2, "s", None, 9, "z", 3), (3, "s", " \n", 9, "z", 3)]
    rows += [(4, "s", "same row", 5, "w", 4)] * 5
    docs = spark.createDataFrame(rows, schema)
    mixed = mixing.mix(docs, shards=3, shard_column="dealt")
    assert mixed.columns == [*docs.columns, "dealt"]
    made = [tuple(r)[:-1] for r in mixed.collect()]
    assert set(made) <= set(rows) and not {2, 3} & {r[0] for r in made}
    plan = mixing.plan_mix(docs, cut=False, shards=3).collect()
    assert sum(len(r["_takes"]) for r in plan) == len(made)
    assert all(r["taken"] == sum(t["words"] for t in r["_takes"]) <= 3 * r["size"] for r in plan)
