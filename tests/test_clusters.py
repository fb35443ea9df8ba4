"""Similar tags, affinity propagation and K-means against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np

from forumscope.operators import affinity, clusters, joins


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def tag_frame(spark, names):
    return spark.createDataFrame([(n,) for n in names], "Tag STRING")


def test_similar_tags_equal_all_pairs(spark):
    rng = random.Random(8)
    names = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(80)})
    for limit in (1, 2, 3):
        got = {(r["a"], r["b"]): r["distance"] for r in affinity.similar_tags(tag_frame(spark, names), limit).collect()}
        pairs = {(a, b): edit_distance(a, b) for a, b in itertools.combinations(names, 2)}
        assert got == {p: d for p, d in pairs.items() if d <= limit}


def test_profiles_equal_distance_rows(spark):
    names = ["rod", "red", "ring", "rind", "a", "bolt", "colt"]
    limit = 2
    tags = tag_frame(spark, names)
    pairs = affinity.similar_tags(tags, limit)
    rows = np.array([[min(edit_distance(a, b), limit + 1) for b in names] for a in names])
    for r in affinity.profile_similarity(tags, pairs, limit).collect():
        difference = rows[names.index(r["i"])] - rows[names.index(r["k"])]
        assert r["s"] == -int((difference**2).sum())


def test_profile_edges_are_all_pairs_with_a_shared_neighbour(spark):
    names = [f"rod-{i:02d}" for i in range(20)] + ["red", "zebra", "quartz"]
    tags = tag_frame(spark, names)
    pairs = affinity.similar_tags(tags, 2)
    edges = affinity.profile_similarity(tags, pairs, 2)
    halves = {r["Tag"]: r["half"] for r in affinity.profile_halves(tags, pairs, 2).collect()}
    rows = np.array([[min(edit_distance(a, b), 3) for b in names] for a in names])
    dense = -((rows[:, None, :] - rows[None, :, :]) ** 2).sum(-1).astype(float)
    found = {(r["i"], r["k"]): r["s"] for r in edges.collect()}
    for i, a in enumerate(names):
        for k, b in enumerate(names):
            if i != k:
                assert found.get((a, b), halves[a] + halves[b]) == dense[i, k]
    assert affinity.median_similarity(edges, affinity.profile_halves(tags, pairs, 2)) == np.median(dense)


def test_median_of_fractions(spark):
    pairs = [("a", "b", -0.9), ("a", "c", -0.8), ("b", "c", -0.7)]
    both = spark.createDataFrame(pairs + [(k, i, s) for i, k, s in pairs], "i STRING, k STRING, s DOUBLE")
    halves = spark.createDataFrame([(t, -5.0) for t in "abc"], "Tag STRING, half DOUBLE")
    assert affinity.median_similarity(both, halves) == -0.7


def dense_affinity(s, damping=0.5, stable=15, limit=200):
    """Affinity propagation on a full matrix, after Frey and Dueck (2007)."""
    n = len(s)
    r, a, history, rows = np.zeros((n, n)), np.zeros((n, n)), [], np.arange(n)
    for _ in range(limit):
        total = a + s
        best = total.argmax(1)
        first = total[rows, best]
        total[rows, best] = -np.inf
        second = total.max(1)
        fresh = s - first[:, None]
        fresh[rows, best] = s[rows, best] - second
        r = damping * r + (1 - damping) * fresh
        positive = np.maximum(r, 0)
        np.fill_diagonal(positive, r.diagonal())
        fresh = positive.sum(0) - positive
        own = fresh.diagonal().copy()
        fresh = np.minimum(fresh, 0)
        np.fill_diagonal(fresh, own)
        a = damping * a + (1 - damping) * fresh
        history.append(tuple((a + r).diagonal() > 0))
        if len(history) > stable and len(set(history[-stable:])) == 1 and any(history[-1]):
            break

    def assign(leaders):
        labels = np.array(leaders)[s[:, leaders].argmax(1)]
        labels[leaders] = leaders
        return labels

    labels = assign(np.flatnonzero(history[-1]).tolist())
    centres = []
    for leader in np.unique(labels):
        members = np.flatnonzero(labels == leader)
        centres.append(members[s[np.ix_(members, members)].sum(0).argmax()])
    return assign(sorted(centres))


def test_affinity_equals_dense_matrix(spark):
    rng = np.random.default_rng(11)
    points = np.concatenate([rng.normal(c, 0.6, size=(6, 2)) for c in ((0, 0), (6, 0), (0, 7))])
    s = -((points[:, None] - points[None]) ** 2).sum(-1)
    names = [f"t{i:02d}" for i in range(len(points))]
    preference = -20.0
    edges = [(names[i], names[k], float(s[i, k])) for i in range(18) for k in range(18) if i != k]
    np.fill_diagonal(s, preference)
    expected = dense_affinity(s)
    got = affinity.affinity_clusters(
        tag_frame(spark, names),
        spark.createDataFrame(edges, "i STRING, k STRING, s DOUBLE"),
        absent=-100.0,
        preference=preference,
    )
    assert {r["Tag"]: r["exemplar"] for r in got.collect()} == {
        names[i]: names[k] for i, k in enumerate(expected)
    }
    members = affinity.cluster_members(got).collect()
    assert len(members) == 18 and len(set(expected)) == len({m["exemplar"] for m in members})


def test_median_counts_absent_pairs(spark):
    edges = spark.createDataFrame([("a", "b", -1), ("b", "a", -1)], "i STRING, k STRING, s INT")
    halves = spark.createDataFrame([(t, -1.5) for t in "abcde"], "Tag STRING, half DOUBLE")
    assert affinity.median_similarity(edges, halves.where("Tag <= 'b'")) == np.median([0, 0, -1, -1])
    assert affinity.median_similarity(edges, halves) == -3.0


def test_weighted_clusters(spark):
    frequency = spark.createDataFrame(
        [("red-rod", 50), ("red-ring", 40), ("blue-bolt", 30), ("blue-gear", 20)], "Tag STRING, tag_frequency BIGINT"
    )
    got = clusters.tag_clusters(frequency, k=2)
    groups = {r["Tag"]: r["cluster"] for r in got.collect()}
    assert groups["red-rod"] == groups["red-ring"] != groups["blue-bolt"] == groups["blue-gear"]
    sizes = [tuple(r)[1:] for r in clusters.cluster_sizes(got).collect()]
    assert sizes == [(90, 2), (50, 2)]


def plain_kmeans(frequency, k, steps):
    """Lloyd's steps on dense TF-IDF vectors, from the same draw of seeds."""
    names = sorted(frequency)
    words = {n: collections.Counter(re.findall(r"[\w]{2,}", n.lower())) for n in names}
    terms = sorted({w for c in words.values() for w in c})
    total = sum(frequency.values())
    df = {w: sum(f for n, f in frequency.items() if w in words[n]) for w in terms}
    x = np.array([[words[n][w] * (math.log((1 + total) / (1 + df[w])) + 1) for w in terms] for n in names])
    length = np.linalg.norm(x, axis=1, keepdims=True)
    x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    weight = np.array([frequency[n] for n in names], float)
    draw = lambda n: -math.log((int(hashlib.md5(f"0|{n}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32) / frequency[n]
    seeds = sorted(names, key=draw)[:k]
    members = {i: [names.index(s)] for i, s in enumerate(seeds)}
    label = None
    for _ in range(steps):
        centres = {c: np.average(x[m], axis=0, weights=weight[m]) for c, m in members.items() if m}
        fresh = [min(centres, key=lambda c: (round(float(centres[c] @ centres[c] - 2 * row @ centres[c]), 9), c)) for row in x]
        if fresh == label:
            break
        label = fresh
        members = {c: [i for i, own in enumerate(label) if own == c] for c in centres}
    return dict(zip(names, label))


def test_kmeans_equals_dense_steps(spark, monkeypatch):
    rng = random.Random(4)
    words = ["red", "blue", "rod", "ring", "plate", "bolt", "anvil", "wire"]
    frequency = {"-".join(rng.sample(words, rng.randint(1, 3))): rng.randint(1, 60) for _ in range(70)} | {"c": 9, "r": 4, "c#": 30}
    frequency |= {f"red-{i:02d}": 3 for i in range(30)}  # a term in many tags
    table = spark.createDataFrame(list(frequency.items()), "Tag STRING, tag_frequency BIGINT")
    expected = plain_kmeans(frequency, 6, 40)
    for limit in (None, 0):  # centres broadcast, and not
        if limit == 0:
            monkeypatch.setattr(clusters, "join_lookup", lambda *a: joins.join_lookup(*a, broadcast_bytes=0))
        made = clusters.tag_clusters(table, k=6, max_iterations=40)
        assert {r["Tag"]: r["cluster"] for r in made.collect()} == expected
    assert clusters.misplaced_tags(made).first()["n_misplaced"] == 0
    assert clusters.tag_clusters(table.where("false"), k=6).count() == 0


def test_few_tags_have_a_cluster_each(spark):
    table = spark.createDataFrame([("red", 5), ("blue", 2)], "Tag STRING, tag_frequency BIGINT")
    assert {r["cluster"] for r in clusters.tag_clusters(table, k=20).collect()} == {0, 1}
