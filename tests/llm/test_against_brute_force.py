"""The operators on the small tables against plain loops over all pairs, windows, words or vectors."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from compare import connect, differences
from conftest import SMALL
from forumscope.llm import (
    components, linededup, mixing, neighbours, packing, pii, queries, rules, simhash, sitequality, suffixes, toxicity,
)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


class Groups:
    def __init__(self, n):
        self.of = list(range(n))

    def find(self, x):
        while self.of[x] != x:
            self.of[x] = self.of[self.of[x]]
            x = self.of[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.of[max(a, b)] = min(a, b)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_sql_counterparts(spark):
    duck = connect(SMALL)
    for name, sql in queries.SQL.items():
        assert differences(queries.QUERIES[name](spark, SMALL), duck, sql) is None


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 150)]
    links = spark.createDataFrame([*chain, *star, (5000, 5001), (7, 7)], "a bigint, b bigint")
    roots = {r["node"]: r["root"] for r in components.components(links).collect()}
    groups = collections.Counter(roots.values())
    assert sorted(groups.values()) == [2, 150, 201]
    assert len({roots[i] for i in range(201)}) == 1


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(texts):
    for text in [*list(texts.values())[:40], None, "", "One", "a b", "x " * 700]:
        assert simhash.fingerprint(text) == plain_print(text)


def test_links_of_all_fingerprints(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for center in list(prints)[:12]:  # crowds and chains around some
        walk = center
        for _ in range(25):
            walk = walk if rng.random() < 0.6 else center
            for _ in range(rng.randint(1, 3)):
                walk ^= 1 << rng.randrange(64)
            prints.add(walk)
    prints = sorted(prints)
    groups = Groups(len(prints))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                groups.link(i, j)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    found = {r["node"]: r["root"] for r in components.components(simhash.links(frame)).collect()}
    sets = collections.defaultdict(set)
    for i, s in enumerate(signed):
        sets[groups.find(i)].add(s)
    made = collections.defaultdict(set)
    for s in signed:
        made[found.get(s, ("alone", s))].add(s)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, made.values()))


def line_tiers(line):
    """The fingerprints of each tier of a line."""
    _, _, tiers, found = linededup.line_prints([line])
    return dict(zip(tiers.tolist(), found.tolist()))


def candidates(one, other):
    """Whether two lines share three blocks of a fingerprint in one of their tiers, and differ in few bits of all."""
    for tier in one.keys() & other.keys():
        apart = [x ^ y for x, y in zip(one[tier], other[tier])]
        if sum(d.bit_count() for d in apart) <= linededup.NEAR_BITS and any(not d & m for d in apart for m in linededup.block_masks()):
            return True
    return False


def repeats_of(texts, only_candidates=True):
    """(doc_id, line number) of every line that goes: all pairs of lines, by edit similarity."""
    nodes = {}
    for doc_id in sorted(texts):
        for number, line in enumerate(linededup.normalised(texts[doc_id])):
            if line:
                nodes.setdefault(line, []).append((doc_id, number))
    lines, groups = [line.decode() for line in nodes], Groups(len(nodes))
    tiers = [line_tiers(line) for line in nodes]
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (not only_candidates or candidates(tiers[i], tiers[j])) and linededup.similar(a, b):
                groups.link(i, j)
    places = collections.defaultdict(list)
    for i, line in enumerate(nodes):
        places[groups.find(i)] += nodes[line]
    return {p for group in places.values() for p in sorted(group)[1:]}, {p for where in nodes.values() for p in where[1:]}


def test_lines(docs, texts):
    gone, _ = repeats_of(texts)
    for row in linededup.without_repeats(docs).select("_row.doc_id", "_text", "_n_removed").collect():
        kept = [x for n, x in enumerate(texts[row["doc_id"]].split("\n")) if (row["doc_id"], n) not in gone]
        assert row["_text"] == "\n".join(kept)
        assert row["_n_removed"] == sum(d == row["doc_id"] for d, _ in gone)


def test_crowds_of_like_and_unlike_lines(spark):
    """Small blocks of pairs give the groups of all pairs, in keys of many lines of several kinds."""
    rng = random.Random(21)
    kinds = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40)) for _ in range(3)]
    lines = {}
    for kind in kinds:
        for _ in range(60):
            words = kind.split()
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(40)] = "".join(rng.choices("abcdefgh", k=5))
            lines[" ".join(words)] = True
    texts = dict(enumerate(lines))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    known = linededup.with_row(docs)
    nodes = linededup.line_table(known).withColumnRenamed("h1", "node")
    place = {r["node"]: r["doc_id"] for r in nodes.select("node", "doc_id").collect()}
    groups, made = Groups(len(texts)), Groups(len(texts))
    tiers = {i: line_tiers(linededup.normalised(text)[0]) for i, text in texts.items()}
    for i in texts:
        for j in range(i):
            if candidates(tiers[i], tiers[j]) and linededup.similar(texts[i], texts[j]):
                groups.link(i, j)
    together = collections.defaultdict(list)
    for r in linededup.line_roots(known, nodes, block=8).collect():
        together[r["root"]].append(place[r["node"]])
    for ids in together.values():
        for other in ids:
            made.link(ids[0], other)
    assert [made.find(i) for i in texts] == [groups.find(i) for i in texts]


def test_similar_lines():
    rng = random.Random(6)
    for _ in range(3000):
        a = "".join(rng.choices("abé ", k=rng.randint(1, 90)))
        changed = list(a)
        for _ in range(rng.randint(0, 25)):
            changed[rng.randrange(len(changed))] = rng.choice("abcd")
        b = "".join(changed)[: rng.randint(1, 95)]
        edits, longer = distance(a, b), max(len(a), len(b))
        assert linededup.edit_distance(a, b, 10**9) == edits
        assert linededup.similar(a, b) == (longer - edits >= 0.8 * longer - 1e-9)


def windows_removed(texts):
    seen = collections.defaultdict(list)
    for i, b in enumerate(texts):
        for p in range(len(b) - 399):
            seen[hashlib.md5(b[p : p + 400]).digest()].append((i, p))
    covered = [bytearray(len(b)) for b in texts]
    for places in seen.values():
        for i, p in places if len(places) > 1 else ():
            covered[i][p : p + 400] = b"\1" * 400
    return [
        (len(b), sum(c), bytes(c).replace(b"\0", b" ").count(b"\1") and len(bytes(c).strip(b"\0").split(b"\0")), bytes(x for x, y in zip(b, c) if not y))
        for b, c in zip(texts, covered)
    ]


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 2])
def test_repeated_bytes(spark, crowd):
    rng = random.Random(5)
    base = ["".join(rng.choices("ab \n", k=1500)) for _ in range(4)]
    texts = [None, "", "short", "a" * 1300, "ab" * 700]
    for _ in range(40):
        a, c = rng.choice(base), rng.choice(base)
        i, x = rng.randint(0, 1000), rng.randint(0, 800)
        text = a[i : i + rng.randint(100, 900)] + rng.choice(["", "zz", "é"]) + c[x : x + rng.randint(300, 700)]
        texts.append(text if rng.random() < 0.8 else text.replace("ab", "ö", 1))
    texts.append(texts[-1])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    wanted = windows_removed([(t or "").encode() for t in texts])
    for row in suffixes.remove(frame, crowd).collect():
        size, removed, _, kept = wanted[row["doc_id"]]
        assert (row["n_bytes"], bytes(row["kept"])) == (size, kept)
        assert sum(s["high"] - s["low"] for s in row["spans"]) == removed
        assert all(a["high"] < b["low"] for a, b in zip(row["spans"], row["spans"][1:]))


def test_long_texts_are_read_in_segments(monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 1000)
    monkeypatch.setattr(suffixes, "CHUNK", 500)
    offsets = np.array([0, 100, 200, 5200, 5300])
    pieces = [(int(a), int(b)) for a, b, _ in suffixes._pieces(offsets)]
    assert pieces[0] == (0, 200) and (200, 1599) in pieces and pieces[-1] == (5200, 5300)
    starts = sorted(s for a, b in pieces if a >= 200 and b <= 5200 for s in range(a, b - 399))
    assert starts == list(range(200, 5200 - 399))


def test_multikey_sort():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, (200, 3)).astype(np.uint64)
    order, common = suffixes.multikey_sort(words)
    rows = [words[i].astype(">u8").tobytes() for i in order]
    assert rows == sorted(rows)
    for a, b, n in zip(rows, rows[1:], common[1:]):
        assert n == next((i for i in range(24) if a[i] != b[i]), 24)


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.pack(docs).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, text in texts.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID]
        pieces = sorted(by_doc[doc_id], key=lambda r: r["start"])
        assert [i for p in pieces for i in p["ids"]] == ids
        for p in pieces:
            assert p["doc_tokens"] == len(ids) and p["length"] == len(p["ids"])
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1].tolist()]
        size = sum(p["length"] for p in pieces)
        assert size <= 2048 and size & (size - 1) == 0  # a power of two: nothing is padded
    steps = collections.Counter()
    for r in rows:
        steps[r["tier"], r["step_group"]] += r["length"]
    assert all(n <= packing.STEP_TOKENS for n in steps.values())


def test_token_ids_of_any_text():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.encoder(packing.tokenizer_path())
    rng = random.Random(3)
    letters = "aBé'sÉßçÑİſΣσς①½ªµ×÷Ÿŉ12.,!?\"-_ \t\n  é<|endoftext|>'ll't've中文😀"
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|> a<|startoftext|>b", "it's we'll I'M"]
    for text, ids in zip(texts, encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            digits = re.findall("[0-9]", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn("".join(digits)),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((kind, m.start(), m.end()))
    return found


def test_base_spans(texts):
    rng = random.Random(1)
    some = ["".join(rng.choices("aB1.@-+ 0942%_()", k=rng.randint(0, 40))) for _ in range(20_000)]
    for text in [*some, *texts.values()]:
        assert pii.base_spans(text) == plain_spans(text)


def test_skip_edges_find_repeats(spark):
    text = "Call +1 (736) 555-2678, mail joe.doe@x.org.\nLater: 736 555-2678 or joe.doe at x.org; order 1234 5678."
    other = "order 736 555-2678 and nothing else"
    rows = pii.find(spark.createDataFrame([(1, text), (2, other)], "doc_id bigint, text string")).collect()
    row = {r["doc_id"]: r for r in rows}
    spans = dict.fromkeys(s for s in row[1]["spans"].split(","))
    at = text.index("736 555-2678")
    assert f"phone:{at}:{at + 12}" in spans and row[1]["n_added"] == 2
    assert row[1]["base_sha256"] == hashlib.sha256(b"email:29:42,phone:5:22").hexdigest()
    assert (row[2]["spans"], row[2]["n_phone"]) == ("", 0)


def test_belief_propagation_on_a_tree_is_exact():
    rng = np.random.default_rng(2)
    unary = rng.normal(size=(4, 3))
    edges = [(0, 1, 1.2), (1, 2, 0.4), (1, 3, 2.0)]
    joint = np.zeros((3,) * 4)
    for labels in np.ndindex(*joint.shape):
        score = sum(unary[i, k] for i, k in enumerate(labels))
        joint[labels] = np.exp(score + sum(w for a, b, w in edges if labels[a] == labels[b]))
    joint /= joint.sum()
    made = pii.beliefs(unary, edges, rounds=500)
    for i in range(4):
        assert np.allclose(made[i], joint.sum(axis=tuple(j for j in range(4) if j != i)), atol=1e-5)


def test_rule_measures(docs, texts):
    for row in rules.judge(docs).collect():
        text = texts[row["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = collections.Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words))
        assert row["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert (row["n_dup_lines"], row["n_repeat_words"]) == (dup, len(covered))
        assert row["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (row["base_failed"] and row["kept"])


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    right = rng.random((20_000, 4)) < np.array([0.95, 0.9, 0.8, 0.7])
    cast = rng.random((20_000, 4)) < 0.7
    votes = np.where(right == truth[:, None], 1, -1) * cast
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, accuracy = rules.fit_label_model(patterns, counts)
    assert ((posterior[which.ravel()] > 0.5) == truth).mean() > 0.93
    assert np.all(np.diff(accuracy) < 0.02)


def test_quality_and_rules_agree_with_labels(docs, labels):
    good = {r["doc_id"]: r["quality"] for r in labels.collect()}
    quality = {r["doc_id"]: r["kept"] for r in sitequality.posteriors(docs, labels).collect()}
    assert all(quality[d] == bool(q) for d, q in good.items())
    judged = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    assert all(judged[d]["kept"] or judged[d]["base_failed"] for d, q in good.items() if q)


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = {"".join(rng.choices("abc", k=rng.randint(4, 8))): rng.random() for _ in range(30)}
    trie = toxicity.Trie([(t, toxicity.WHOLE, w) for t, w in terms.items()])
    for _ in range(3000):
        word = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
        near = [w for t, w in terms.items() if len(t) >= 5 and distance(t, word) <= 1]
        assert trie.fuzzy(word) == max(near, default=None)


def test_quotation_is_told_apart():
    known = toxicity.Words(toxicity.Trie([("idiot", toxicity.WHOLE, 5.0)]))
    abuse = toxicity.hit_features("you are an idiot and an idiott", known)
    quote = toxicity.hit_features('they said "what an idiot" to us', known)
    assert abuse[0] == 1.0 and abuse[2] == 1.0 and quote[0] == 0.0 and quote[3] == 1.0


def test_toxicity_learns_without_held_out_rows(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    rows = []
    for i in range(600):
        text = rng.choices(words, k=40)
        bad = i % 6 == 0
        if bad:
            text[rng.randrange(40)] = rng.choice(["zuckmaul", "zuckmaull", "rotznase"])
        rows.append((i, " ".join(text), int(bad)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    made = toxicity.score(frame, frame).collect()
    for r in made:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    wrong = sum(r["predicted"] != (r["doc_id"] % 6 == 0) for r in made if r["held_out"])
    assert wrong <= 4


def test_neighbours_recall(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(1500, 16)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    vectors[1000:1300] = vectors[0]  # many copies
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, vec array<float>")
    made = collections.defaultdict(list)
    for r in neighbours.nearest(rows, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        made[r["query_id"]].append(r["vec_id"])
    exact = vectors.astype(float)
    found = 0
    for q in range(0, 1500, 20):
        score = exact @ exact[q]
        score[q] = -np.inf
        found += len(set(np.lexsort((np.arange(1500), -score))[:20]) & set(made[q]))
        assert len(made[q]) == 20 and q not in made[q]
    assert found / (75 * 20) >= 0.95


def test_split_tree_is_exact():
    quotas = {"a": 1000, "b": 37, "c": 0}
    made = mixing.split_quotas(quotas, 16)
    assert {k: sum(v) for k, v in made.items()} == quotas
    totals = np.sum(list(made.values()), axis=0)
    assert totals.max() - totals.min() <= 1


@pytest.mark.parametrize("shards", [1, 5, 64, 300])
def test_split_tree_as_jobs(spark, shards):
    quotas = {"hot": 4000, "b": 370, "c": 1, "none": 0}
    rows = mixing.split_tree(spark.createDataFrame(list(quotas.items()), "_key string, _quota bigint"), shards).collect()
    assert all(r["_quota"] > 0 and 0 <= r["_shard"] < shards for r in rows)
    given, totals = collections.Counter(), collections.Counter({s: 0 for s in range(shards)})
    for r in rows:
        given[r["_key"]] += r["_quota"]
        totals[r["_shard"]] += r["_quota"]
    assert given == collections.Counter({k: n for k, n in quotas.items() if n})
    assert len({(r["_key"], r["_shard"]) for r in rows}) == len(rows)
    assert max(totals.values()) - min(totals.values()) <= 1
    if shards == 64:  # one job of six levels draws what the tree in memory draws
        alone = mixing.split_quotas({k: n for k, n in quotas.items() if n}, shards)
        assert {(r["_key"], r["_shard"]): r["_quota"] for r in rows} == {
            (k, s): n for k, ns in alone.items() for s, n in enumerate(ns) if n
        }


@pytest.mark.parametrize("shards", [7, 64])
def test_blocks_are_dealt_once(spark, docs, shards):
    rows = mixing._sized(docs, mixing.SEED)
    sizes = mixing.stored(rows.select("_source", "_key", "_size", "_place"), "test-sizes")
    ends = mixing._ends(sizes, 3)
    dealt = mixing.deal_blocks(ends, shards).collect()
    assert len({(r["_key"], r["_block"]) for r in dealt}) == len(dealt)
    for r in dealt:
        assert 0 <= r["_block"] < r["_blocks"]
        assert [d["pass"] for d in r["_dealt"]] == list(range(len(r["_dealt"])))
    held = collections.Counter(d["shard"] for r in dealt for d in r["_dealt"])
    assert len(held) == shards and max(held.values()) - min(held.values()) <= 1
    # of a source, every shard holds what a draw without replacement gives it: within five deviations of its share
    total = sum(held.values())
    for key in {r["_key"] for r in dealt}:
        mine = collections.Counter(d["shard"] for r in dealt if r["_key"] == key for d in r["_dealt"])
        share = sum(mine.values()) / total
        for shard, n in held.items():
            assert abs(mine[shard] - n * share) <= 5 * (n * share * (1 - share)) ** 0.5 + 1


def test_a_shard_is_a_partition(spark, docs):
    mixed = mixing.mix(docs, shards=40, shard_column="shard").withColumn("part", F.spark_partition_id())
    rows = mixed.select("doc_id", "shard", "part").collect()
    assert all(r["shard"] == r["part"] for r in rows) and len({r["shard"] for r in rows}) > 30
    plan = {r["doc_id"]: r for r in mixing.plan_mix(docs, cut=False, shards=40).collect()}
    assert collections.Counter((r["doc_id"], r["shard"]) for r in rows) == collections.Counter(
        (d, t["shard"]) for d, r in plan.items() for t in r["_takes"]
    )
    in_order = [r["doc_id"] for r in rows if r["shard"] == rows[0]["shard"]]
    assert in_order != sorted(in_order)
    with pytest.raises(ValueError, match="column of the documents"):
        mixing.mix(docs, shard_column="Source")


def test_mix_meets_targets(spark, docs):
    plan = {r["doc_id"]: r for r in mixing.plan_mix(docs).collect()}
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    taken, target = collections.Counter(), {}
    for doc_id, r in plan.items():
        taken[source[doc_id]] += r["taken"]
        target[source[doc_id]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    whole = collections.Counter(r["doc_id"] for r in mixing.mix(docs).select("doc_id").collect())
    assert all(abs(n * plan[d]["size"] - plan[d]["taken"]) < plan[d]["size"] for d, n in whole.items())
    assert sorted(whole.elements()) == sorted(r["doc_id"] for r in mixing.mix(docs.repartition(5)).select("doc_id").collect())


def test_pipeline(spark, texts):
    made = corpus_pipeline.run(spark, SMALL)
    rows = made.select("doc_id", "start", "length", "doc_tokens").collect()
    assert rows and {r["doc_id"] for r in rows} <= set(texts)
    assert all(r["start"] + r["length"] <= r["doc_tokens"] for r in rows)


def test_lines_by_edit_similarity_alone(docs, texts):
    """All pairs by edit distance, without a filter: nothing is joined that is not similar. Of what is, SimHash finds 0.8 here (README), mostly longer lines."""
    gone, repeated = repeats_of(texts, only_candidates=False)
    rows = {r["row"]: r["doc_id"] for r in linededup.with_row(docs).collect()}
    made = {(rows[r["row"]], n) for r in linededup.repeats(docs).collect() for n in r["gone"]}
    assert made <= gone
    assert len(gone - repeated) >= 40 and len(made - repeated) >= 0.75 * len(gone - repeated)


@pytest.mark.parametrize("words, least", [((21, 40), 0.9), ((41, 80), 0.9), ((81, 200), 0.9)])
def test_lines_with_a_small_edit_are_candidates(texts, words, least):
    rng = random.Random(3)
    lines = sorted({line for text in texts.values() for line in linededup.normalised(text) if line})
    others = [w for line in lines[:400] for w in line.split()]
    found = tried = 0
    for line in rng.choices([x for x in lines if words[0] <= len(x.split()) <= words[1]], k=300):
        left = line.split()
        left[rng.randrange(len(left))] = rng.choice(others)
        if linededup.similar(line.decode(), b" ".join(left).decode()):
            tried += 1
            found += candidates(line_tiers(line), line_tiers(b" ".join(left)))
    assert tried > 200 and found >= least * tried


def fingerprint_groups(texts):
    """For each id the least id of its group, by all pairs of fingerprints."""
    ids = sorted(texts)
    prints, groups = [plain_print(texts[i]) for i in ids], Groups(len(ids))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                groups.link(i, j)
    return {d: ids[groups.find(i)] for i, d in enumerate(ids)}


def test_near_copies_of_the_stage(spark, texts):
    rng = random.Random(8)
    words = [w for text in list(texts.values())[:50] for w in (text or "").split()]
    rows = dict(enumerate(text for text in texts.values() if len((text or "").split()) <= 2000))
    for _ in range(120):  # copies with some words changed, in chains
        changed = rows[rng.choice(list(rows))].split()
        for _ in range(rng.randint(0, len(changed) // 60)):
            changed[rng.randrange(len(changed))] = rng.choice(words)
        rows[len(rows)] = " ".join(changed)
    frame = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    kept = sorted(r["doc_id"] for r in simhash.keep_one(frame).collect())
    assert kept == sorted(set(fingerprint_groups(rows).values())) and len(kept) <= len(rows) - 40


def test_misspellings_of_light_terms():
    rng = random.Random(12)
    terms = {"".join(rng.choices("abcdefgh", k=rng.randint(5, 9))): rng.random() for _ in range(900)}
    trie = toxicity.Trie([(t, toxicity.WHOLE, w) for t, w in terms.items()])
    for term in sorted(terms, key=terms.get)[:300]:  # the lightest
        at = rng.randrange(len(term))
        for word in (term[:at] + "x" + term[at:], term[:at] + "x" + term[at + 1 :], term[:at] + term[at + 1 :]):
            assert trie.fuzzy(word) == max(w for t, w in terms.items() if abs(len(t) - len(word)) < 2 and distance(t, word) <= 1)


def test_lexicon_keeps_rare_terms_that_are_no_chance(spark):
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    rows = []
    for i in range(12000):
        text = rng.choices(words, k=10)
        bad = i % 4 == 0
        if bad and i < 40:  # ten of three thousand
            text.append("rotznase")
        rows.append((" ".join(text), int(bad)))
    frame = spark.createDataFrame(rows, "text string, toxic int")
    assert "rotznase" not in {t for t, _, _ in toxicity.learn_lexicon(frame.where("toxic = 0 or text not like '%rotznase%'"))}
    whole = {t for t, kind, _ in toxicity.learn_lexicon(frame) if kind == toxicity.WHOLE}
    assert whole == {"rotznase"}


def plain_takes(left):
    """How often each document is taken whole; ``left``: doc_id to source and words."""
    sizes = collections.Counter()
    for source, n in left.values():
        sizes[source] += n
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    by_cap = sorted(order, key=lambda s: 3 * sizes[s] / weight[s])
    total = sum(sizes.values())
    level = max(
        (total - sum(3 * sizes[s] for s in by_cap[:k])) / sum(weight[s] for s in by_cap[k:]) for k in range(len(by_cap))
    )
    takes = {}
    for source in order:
        quota = int(min(level * weight[source], 3 * sizes[source]) + 0.5)
        whole, rest = divmod(quota, sizes[source])
        place = lambda d: int(hashlib.md5(f"17|{d}".encode()).hexdigest()[:15], 16)
        for doc_id in sorted((d for d in left if left[d][0] == source), key=place):
            size = left[doc_id][1]
            takes[doc_id] = whole + (size > 0 and 2 * max(0, min(size, rest)) >= size) if size else 0
            rest -= size
    return takes


def test_pipeline_against_a_plain_chain(spark, docs, labels):
    from tokenizers import Tokenizer

    stages, tables, now = dict(corpus_pipeline.STAGES), {}, docs
    for name, stage in stages.items():
        now = tables[name] = corpus_pipeline.stored(stage(spark, now, SMALL), f"plain-{name}")
    judged = sitequality.posteriors(docs, labels).collect()
    good = {r["doc_id"] for r in judged if r["posterior"] >= 0.5}
    rows = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in good}
    assert sorted(r["doc_id"] for r in tables["quality"].collect()) == sorted(rows)

    gone, _ = repeats_of({d: r["text"] for d, r in rows.items()})
    texts = {}
    for doc_id, r in rows.items():
        text = "\n".join(x for n, x in enumerate(r["text"].split("\n")) if (doc_id, n) not in gone)
        if text == r["text"] or text.split():
            texts[doc_id] = text
    assert {r["doc_id"]: r["text"] for r in tables["line_dedup"].collect()} == texts

    kept = set(fingerprint_groups(texts).values())
    assert sorted(r["doc_id"] for r in tables["near_dedup"].collect()) == sorted(kept)

    left = {d: (rows[d]["source"], len(texts[d].encode().split())) for d in kept}
    takes = plain_takes(left)
    mixed = collections.Counter(r["doc_id"] for r in tables["mix_sources"].collect())
    assert mixed == collections.Counter({d: n for d, n in takes.items() if n})

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokens = {d: [*tokenizer.encode(texts[d], add_special_tokens=False).ids, packing.END_ID] for d in mixed}
    pieces = tables["pack_sequences"].collect()
    assert {r["doc_id"] for r in pieces} == set(mixed)
    covered = {d: np.zeros(len(t), int) for d, t in tokens.items()}
    for r in pieces:
        span = slice(r["start"], r["start"] + r["length"])
        assert list(r["ids"]) == tokens[r["doc_id"]][span]
        covered[r["doc_id"]][span] += 1
    assert all((n == mixed[d]).all() for d, n in covered.items())
    same = lambda df: sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in df.collect())
    assert same(corpus_pipeline.run(spark, SMALL)) == same(tables["pack_sequences"])
