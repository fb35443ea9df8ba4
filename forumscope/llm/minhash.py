"""Near copies by MinHash: many universal hash minima with banding, signature and set verification, star components.

A document's set is its different five-word shingles; documents link at a Jaccard similarity of at least 0.85. Equal sets are one node
from the start, so copies cost a row each and no link. A node's signature holds the minima of 224 universal hash functions over its shingles; 32 bands of
seven minima are its keys. Nodes at 0.85 share no key with a probability of 4e-6, nodes at 0.5 share one with 0.22.

First every node is compared with one node of its key, the least in one of four orders, so that a large group meets a few different centres;
most keys are of one component then and done. The nodes of a key that is not are dealt over blocks of 128, and every two blocks of the key meet in one task, which compares nodes of
different components and returns a spanning forest of the links: no pairs are ever rows, no task holds more than two blocks, and nothing is
capped. (Nodes that share a key, and yet are of different components, have to be compared: that part of the work is of the second order in their
number, in steps of blocks.)

A pair is compared by its signatures (a byte of each minimum) first: it goes on unless the share of equal bytes is six standard
deviations below 0.85. The link is confirmed on the full sets of shingles, as 64-bit hashes, made from the texts of candidates only.

Defined results: a null, empty or wordless text has an empty set, no links, and its own doc_id as component_id; fewer than five words are one
shingle; texts are whole whatever their length; repeated rows and rows that share a doc_id are a row each; a null doc_id is named only
if its whole component has none; an empty table gives an empty result; only ``doc_id`` and ``text`` are read, other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from forumscope.llm.common import map_arrow, small, stored, table
from forumscope.llm.pairblocks import BLOCK, Forest, compared, dealt
from forumscope.llm.stars import star_components

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 32, 7
SEED = 13
CHUNK = 1024  # shingles that are hashed at once: their minima stay in the processor's cache
ORDERS = (0, -1, 0x5555555555555555, -0x5555555555555556)  # signed masks: four orders of the nodes


def _universal(seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed).integers(0, 1 << 32, (2, BANDS * ROWS), dtype=np.uint64).astype(np.uint32)
    return draw[0] | np.uint32(1), draw[1]


FACTORS, SHIFTS = _universal(SEED)


def least_share(percent: int = PERCENT) -> int:
    """Equal signature bytes that a pair needs: six standard deviations below what the similarity gives."""
    n, p = BANDS * ROWS, percent / 100
    p += (1 - p) / 256
    return int(n * p - 6 * (n * p * (1 - p)) ** 0.5)


def shingle_list(text: str | None, shingle: int = SHINGLE) -> list[bytes]:
    """Every shingle of the text, words joined by a space; fewer words are one shingle, none give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()
    return [joined[s:e] for s, e in zip(starts, ends[shingle - 1 :] or ends[-1:])]


def set_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different hashes of a text's shingles, ascending."""
    return np.unique(np.array([xxhash.xxh64_intdigest(s) for s in shingle_list(text, shingle)], dtype="<u8"))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set's hashes."""
    least = np.full(len(FACTORS), 0xFFFFFFFF, dtype=np.uint32)
    low = (hashes ^ hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), CHUNK):
        np.minimum(least, (low[at : at + CHUNK, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    return least


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, copy (a hash of the text), n_shingles, node (a hash of the set, null if empty), keys and signature bytes."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    digest = xxhash.xxh64_intdigest

    def sketch(text: str | None) -> tuple[int, int | None, list[int] | None, bytes | None]:
        hashes = set_hashes(text, shingle)
        if not len(hashes):
            return 0, None, None, None
        least = signature(hashes)
        bands = least.reshape(BANDS, ROWS)
        keys = [digest(band.tobytes(), n) - (1 << 63) for n, band in enumerate(bands)]
        return len(hashes), digest(hashes.tobytes()) - (1 << 63), keys, (least & np.uint32(255)).astype(np.uint8).tobytes()

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            made = [sketch(t.as_py()) for t in batch.column("text")]
            columns = [list(c) for c in zip(*made, strict=True)] or [[], [], [], []]
            return {"doc_id": batch.column("doc_id"), "copy": batch.column("copy")} | dict(zip(("n_shingles", "node", "keys", "bytes"), columns))

        return work

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("copy"))
    return map_arrow(rows, f"doc_id {kind}, copy bigint, n_shingles bigint, node bigint, keys array<bigint>, bytes binary", make)


def agree(x: np.ndarray, y: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, least: int) -> bool:
    """Whether a pair links: by its signatures (x, y), then by its full sets of hashes, ascending (left, right)."""
    small_, large = sorted((len(left), len(right)))
    if 100 * small_ < percent * large or int((x == y).sum()) < least:
        return False
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * both >= percent * (len(left) + len(right) - both)


def full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node, bytes and the ascending hashes of its set, for the wanted nodes only. ``docs``: text, copy; ``nodes``: node, copy, bytes."""
    places = stored(nodes.join(small(wanted), "node").select("node", "bytes", F.col("copy").alias("_copy")), "minhash-wanted")
    texts = docs.join(small(places.select("_copy")), F.col("copy") == F.col("_copy"), "left_semi")
    texts = texts.groupBy("copy").agg(F.min("text").alias("text")).join(places, F.col("copy") == F.col("_copy"))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sets = [set_hashes(t.as_py(), shingle).tobytes() for t in batch.column("text")]
            return {"node": batch.column("node"), "bytes": batch.column("bytes"), "hashes": sets}

        return work

    return stored(map_arrow(texts.select("node", "bytes", "text"), "node bigint, bytes binary, hashes binary", make), "minhash-sets")


def verified(sets: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that link."""
    for side in "ab":
        pairs = pairs.join(sets.toDF(side, f"{side}_bytes", f"{side}_hashes"), side)
    least = least_share(percent)

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            x, y = (_arrays(batch, f"{side}_bytes", np.uint8) for side in "ab")
            left, right = (_arrays(batch, f"{side}_hashes", "<u8") for side in "ab")
            found = batch.filter(pa.array([agree(*row, percent, least) for row in zip(x, y, left, right)], pa.bool_()))
            return {"a": found.column("a"), "b": found.column("b")}

        return work

    return map_arrow(pairs.select("a", "b", "a_bytes", "b_bytes", "a_hashes", "b_hashes"), "a bigint, b bigint", make)


def _arrays(batch: pa.RecordBatch, column: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(v.as_py(), kind) for v in batch.column(column)]


def block_links(members: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Links between different components of a key. ``members``: key, node, root and n, the number of the key's nodes.

    Every pair of blocks returns a spanning forest: fewer links than nodes.
    """
    least = least_share(percent)

    def make():
        def find(rows: list[tuple], one: bool) -> list[tuple[int, int]]:
            forest, found = Forest(r[3] for r in rows), []
            if len(forest.of) < 2:
                return found
            prints = np.stack([np.frombuffer(r[4], np.uint8) for r in rows])
            sets = [np.frombuffer(r[5], "<u8") for r in rows]
            sizes = np.array([len(h) for h in sets])
            second = np.array([r[1] for r in rows])
            for i, row in enumerate(rows):
                to = np.arange(len(rows)) > i if one else second & (not row[1])
                to = np.flatnonzero(to & (100 * sizes >= percent * sizes[i]) & (100 * sizes[i] >= percent * sizes))
                for j in to[(prints[to] == prints[i]).sum(axis=1) >= least].tolist():
                    apart = forest.root(row[3]) != forest.root(rows[j][3])
                    if apart and agree(prints[i], prints[j], sets[i], sets[j], percent, least):
                        forest.join(row[3], rows[j][3])
                        found.append((row[2], rows[j][2]))
            return found

        return find

    placed = dealt(members, block).join(sets, "node")
    return compared(placed, ("node", "root", "bytes", "hashes"), "a bigint, b bigint", make)


def _in_order(node: Column, key: Column) -> Column:
    """The node in the key's order; applied twice it is the node again."""
    mask = F.element_at(F.array(*map(F.lit, ORDERS)), (F.pmod(key, F.lit(len(ORDERS))) + 1).cast("int"))
    return node.bitwiseXOR(mask)


def links(docs: DataFrame, made: DataFrame, nodes: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """Links a, b with the components of all candidate pairs that are similar. ``made``: ``sketches`` of ``docs``; ``nodes``: one row a node."""
    keyed = made.where("node is not null").select("node", F.explode("keys").alias("key"))
    place = _in_order(F.col("node"), F.col("key"))
    shared = keyed.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    shared = stored(shared.where("first <> last").select("key", _in_order(F.col("first"), F.col("key")).alias("centre")), "minhash-keys")
    members = stored(keyed.join(small(shared), "key").distinct(), "minhash-members")
    sets = full_sets(docs, nodes, members.select("node").distinct(), shingle)
    pairs = members.where("node <> centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    star = stored(verified(sets, stored(pairs, "minhash-pairs"), percent), "minhash-links")
    rooted = members.join(star_components(star), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    rooted = stored(rooted, "minhash-rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("_one"), F.max("root").alias("_other"), F.count("*").alias("n"))
    mixed = stored(mixed.where("_one <> _other").where("n > 2").select("key", "n"), "minhash-mixed")
    rest = rooted.join(small(mixed), "key")
    return star.union(stored(block_links(rest, sets, percent, block), "minhash-links"))


def near_groups(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    rows = docs.select("text", F.xxhash64("text").alias("copy"))
    made = stored(sketches(docs, shingle), "minhash-sketches")
    nodes = made.where("node is not null").groupBy("node")
    nodes = stored(nodes.agg(F.min("copy").alias("copy"), F.min("doc_id").alias("first"), F.min("bytes").alias("bytes")), "minhash-nodes")
    roots = star_components(links(rows, made, nodes, percent, shingle))
    linked = nodes.select("node", "first").join(roots, "node")
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = linked.select("node", "root").join(least, "root").select("node", "component_id")
    named = nodes.select("node", "first").join(linked, "node", "left").select("node", F.coalesce("component_id", "first").alias("component_id"))
    found = made.select("doc_id", "n_shingles", "node").join(small(stored(named, "minhash-names")), "node", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op13_minhash(spark, folder: str) -> DataFrame:
    found = near_groups(table(spark, folder, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


# The similarity is over all pairs that share a shingle, the components by a walk from every document: for tables of the tests' size.
OP13_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(len(w) - {SHINGLE - 1}), lambda i: array_to_string(w[i + 1 : i + {SHINGLE}], ' ')) END) AS s
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS same FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * same >= {PERCENT} * (p.n + q.n - same)
), reach(doc_id, other) AS (
  SELECT a, a FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), least AS (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
