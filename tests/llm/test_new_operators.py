"""Resampling, the manifest and MinHash against plain versions, on odd rows and on keys of many members."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from forumscope.llm import manifest, minhash, resampling, stars

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `group` int, node string, place int, bucket int, rank int"
WORDS = "the river ran under an old stone bridge while seven quiet people watched it from above"
LONG = " ".join(f"{w}{i}" for i in range(4000) for w in ("alpha", "beta"))


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 2, 3, 4) for r in rows], SCHEMA).repartition(3)


ODD = [
    (1, WORDS + " " + WORDS, "en", "a", 10),
    (1, WORDS + " " + WORDS, "en", "a", 10),
    (1, "Another text\nthat shares its id", "en", "a", 10),
    (2, WORDS, "en", None, 10),
    (3, None, None, "a", None),
    (4, "", None, "b", 0),
    (5, "\n \t\r\n", "de", None, 5),
    (None, WORDS.upper() + "\n!", "fr", "b", 9),
    (None, "ß Ö ö　x \x00 nul", "de", "", 3),
    (6, LONG, "en", "b", len(LONG)),
]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_resample(docs, target, longest, buckets, percent, least):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s = collections.Counter(b for _, text in docs for b in features(text))
    t = collections.Counter(b for text in target for b in features(text))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    made = []
    for doc_id, text in docs:
        found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        made.append((doc_id, len(words(text)), len(found), weight, score))
    drawn = sorted((r for r in made if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = sorted(r[4] for r in drawn)[::-1][: percent * len(drawn) // 100]
    return sorted(map(str, made)), ranks


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 70_000), (2, 7)])
def test_resampling(spark, odd, longest, buckets):
    rng = random.Random(longest)
    words = ["red", "Blue", "stone", "x1", "über", "don't"]
    rows = [r[:2] for r in ODD] + [(i, " ".join(rng.choices(words, k=rng.randint(0, 30)))) for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    target = [WORDS, None, "red stone " * 9]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    made = resampling.resample(docs, aim, longest, buckets, percent=30, least_words=3).collect()
    expected, ranks = plain_resample(rows, target, longest, buckets, 30, 3)
    assert sorted(str((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"])) for r in made) == expected
    drawn = sorted((r["rank"], r["score"], r["doc_id"]) for r in made if r["rank"] is not None)
    assert [r[0] for r in drawn] == list(range(1, len(ranks) + 1)) and [r[1] for r in drawn] == ranks
    assert all(a[2] <= b[2] for a, b in zip(drawn, drawn[1:]) if a[1] == b[1] and None not in (a[2], b[2]))


def test_resampling_of_nothing(spark, odd, empty):
    assert resampling.resample(empty, odd).count() == 0
    made = resampling.resample(odd, empty.select("text"), percent=100, least_words=0).collect()
    assert len(made) == len(ODD) and sorted(r["rank"] for r in made) == list(range(1, len(ODD) + 1))
    assert all(r["weight"] == 0 for r in made if r["n_features"] == 0)


def plain_manifest(rows, tampered):
    """rows: (order, group, leaf). The root, and for each row its subroot, proof and folded root."""
    H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()

    def tree(nodes):
        paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
        while len(level) > 1:
            for i, k in enumerate(at):
                start = k // 3 * 3
                paths[i].append(("".join(level[start:k]), "".join(level[k + 1 : start + 3])))
            level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
            at = [k // 3 for k in at]
        return level[0], paths

    groups = collections.defaultdict(list)
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([r[2] for r in groups[g]]) for g in names}
    root, above = tree([trees[g][0] for g in names])
    made = []
    for g, over in zip(names, above):
        for row, path in zip(groups[g], trees[g][1]):
            node = tampered.get(row[2], row[2])
            for left, right in path + over:
                node = H(left, node, right)
            made.append((row[0], row[2], trees[g][0], root, H(*(x + y for x, y in path + over)), node))
    return sorted(map(str, made))


def plain_leaf(values):
    parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values]
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def made_manifest(docs, text):
    found = manifest.document_manifest(docs, given=manifest.leaf(manifest.COLUMNS, {"text": text}))
    node = manifest.folded(F.col("given"), F.col("path"))
    proof = F.sha2(manifest.siblings(F.col("path")), 256)
    return sorted(str(tuple(r)) for r in found.select("doc_id", "leaf", "subroot", "root", proof, node).collect())


def test_manifest(spark, odd, empty):
    rng = random.Random(2)
    many = [(i, f"text {i}\n", "en", rng.choice("cde") if i % 3 else "hot", i) for i in range(1500)]
    for rows in (ODD, ODD[:1], ODD + many, ODD + many[:244]):
        plain = [(r[0], r[3], plain_leaf((r[0], r[3], r[2], r[4], r[1]))) for r in rows]
        other = {leaf: plain_leaf((r[0], r[3], r[2], r[4], None if r[1] is None else r[1].replace("\n", ""))) for r, (_, _, leaf) in zip(rows, plain)}
        changed = F.replace("text", F.lit("\n"), F.lit(""))
        assert made_manifest(documents(spark, rows), changed) == plain_manifest(plain, other)
    assert made_manifest(empty, F.col("text")) == []


def plain_near(rows, percent=85):
    sets = []
    for _, text in rows:
        w = lowered(text).encode().split()
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    of = list(range(len(rows)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= percent * len(a | b) > 0:
                x, y = find(i), find(j)
                of[max(x, y)] = min(x, y)
    groups = collections.defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(str((d, len(s), least[find(i)] if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("block", [128, 7])
def test_minhash(spark, block, monkeypatch):
    """Chains and crowds of copies with some words changed, so that keys hold several components."""
    rng = random.Random(block)
    monkeypatch.setattr(minhash.links, "__defaults__", (*minhash.links.__defaults__[:-1], block))
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    rows = [r[:2] for r in ODD] + [(10 + i, " ".join(rng.choices(words, k=rng.randint(3, 150)))) for i in range(60)]
    base = " ".join(rng.choices(words, k=120))
    for i in range(130):
        left = (base if i % 2 else rng.choice(rows[10:])[1]).split()
        for _ in range(rng.randint(0, 6)):
            left[rng.randrange(len(left))] = rng.choice(words)
        rows.append((1000 + i, " ".join(left)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(str(tuple(r)) for r in minhash.near_groups(docs).collect()) == plain_near(rows)


def test_minhash_of_odd_rows(odd, empty):
    assert sorted(str(tuple(r)) for r in minhash.near_groups(odd).collect()) == plain_near([r[:2] for r in ODD])
    assert minhash.near_groups(empty).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.85, 0.5):
        both = rng.integers(0, 1 << 63, int(4000 * share), dtype=np.uint64)
        x, y = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, (4000 - len(both)) // 2, dtype=np.uint64)])) for _ in "xy")
        equal = (minhash.signature(x) == minhash.signature(y)).mean()
        assert abs(equal - share) < 0.12


def test_star_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    graph = [(rng.randrange(5000, 5400), rng.randrange(5000, 5400)) for _ in range(250)]
    links = [*chain, *star, *graph, (7, 7), (9000, 9000)]
    rng.shuffle(links)
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in stars.star_components(frame).collect()}
    of = {x: x for pair in links for x in pair}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        of[max(x, y)] = min(x, y)
    assert found == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert stars.star_components(frame.where("false")).count() == 0
