"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint has 64 bits; documents link at three or fewer differing bits, and a component of links is a
group of near copies. Equal fingerprints are joined into one node first, so exact copies cost one row a copy and no
link.

Finding the links meets in the middle. Two fingerprints three bits apart meet at a variant one bit from one and two
bits from the other; of the three bits two lie in the same half, so it is enough that every fingerprint emits itself and
its 64 variants at one bit (near), and its 992 variants at two bits of one half (far). Whatever meets at a variant
is within three bits if one of the two is near, so a bucket is linked as a star around its least near fingerprint,
needs no verification and never forms all pairs; a bucket can hold no more than 1,057 fingerprints. The star has the
same components as the pairs.

1,057 variants of every fingerprint would be a shuffle far larger than the texts. So a screen comes first: one of four
16-bit blocks is erased and the other 48 bits, as they are and with each bit flipped, are the 196 keys of a
fingerprint. Of three differing bits one lies in an erased block, and the other two meet in the middle at one bit each, so
linked fingerprints always share a key. Keys are counted (combined before the shuffle). A key of two
fingerprints is verified at once; only fingerprints with a key of three or more, the dense groups of near copies, emit their whole
ball.

``keep_one``, the stage of the pipeline, keeps one row of each group of these links.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; a null doc_id has a
fingerprint and its group's component_id, but is never a component_id unless the whole group has none; repeated rows
are a row each here, and ``keep_one`` keeps one of them; it decides by row (doc_id and text), so different texts with one doc_id, or
with none, stay apart; an empty table gives an empty result; other columns are ignored, or
carried by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from forumscope.llm.common import map_arrow, packed, small, stored, table
from forumscope.llm.components import components
from forumscope.operators.joins import fits_broadcast

RADIUS = 3
SHINGLE = 3
SEED = 42
FULL = (1 << 64) - 1
TASK_PRINTS = 10_000  # 196 keys each: what a task combines fits memory


def bit_majority(hashes: np.ndarray) -> int:
    """The 64-bit number whose bits are set in over half of the hashes.

    Each byte is looked up as eight one-byte counters in a 64-bit word; 255 of them add without overflow.
    """
    if not len(hashes):
        return 0
    lanes = SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(hashes), 255), axis=0)
    counts = sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _spread() -> np.ndarray:
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view("<u8")[:, 0].copy()


SPREAD = _spread()


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The hash of each of the text's word shingles; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends.tolist()[shingle - 1 :] or ends.tolist()[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=False)]
    return np.array(hashes, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, unsigned; 0 for a text without words."""
    return bit_majority(shingles(text, shingle))


def fingerprints(docs: DataFrame, *carry: str) -> DataFrame:
    """The carried columns (doc_id, if none is named) and the fingerprint of every text as a signed 64-bit number."""
    carry = carry or ("doc_id",)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema]

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
            return {c: batch.column(c) for c in carry} | {"fp": pa.array(prints.view(np.int64))}

        return work

    return map_arrow(docs.select(*carry, "text"), ", ".join([*kinds, "fp bigint"]), make)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _each(values: list[tuple[int, ...]], names: tuple[str, ...]) -> Column:
    """A row for each of some constant tuples."""
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(t, names, strict=True)]) for t in values]))


def screen_keys(prints: DataFrame) -> DataFrame:
    """fp and its 196 keys: 48 bits, as they are or with one flipped; the erased block holds the block's number."""
    changes = []
    for block in range(4):
        erased = 0xFFFF << (16 * block)
        for flip in [0] + [1 << i for i in range(64) if not erased >> i & 1]:
            changes.append((_signed(FULL ^ erased), _signed(flip | (block + 1) << (16 * block))))
    key = F.col("_c.keep").bitwiseAND(F.col("fp")).bitwiseXOR(F.col("_c.put"))
    return prints.select("fp", _each(changes, ("keep", "put")).alias("_c")).select("fp", key.alias("key"))


def balls(prints: DataFrame) -> DataFrame:
    """fp, its 1,057 variants, and whether a variant is near (one bit at most)."""
    near = [(_signed(m), 1) for m in [0] + [1 << i for i in range(64)]]
    far = [
        (_signed(1 << i | 1 << j), 0) for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)
    ]
    variant = F.col("fp").bitwiseXOR(F.col("_c.flip"))
    flips = _each(near + far, ("flip", "near")).alias("_c")
    return prints.select("fp", flips).select("fp", variant.alias("variant"), F.col("_c.near").alias("near"))


def links(prints: DataFrame) -> DataFrame:
    """Links a, b whose components are those of all fingerprints at three or fewer differing bits."""
    keys = screen_keys(prints.repartition(max(1, -(-prints.count() // TASK_PRINTS)), "fp"))
    shared = keys.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n"))
    shared = stored(shared.where("n > 1"), "simhash-keys")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    pairs = shared.where("n = 2").where(apart <= RADIUS).select("a", "b").distinct()
    crowded = shared.where("n > 2").select("key")
    if fits_broadcast(crowded):
        crowded = F.broadcast(crowded)
    dense = stored(keys.join(crowded, "key", "left_semi").select("fp").distinct(), "simhash-dense")
    center = F.min(F.when(F.col("near") == 1, F.col("fp"))).over(Window.partitionBy("variant"))
    stars = balls(dense).withColumn("a", center).where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.union(stars)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every document."""
    prints = stored(fingerprints(docs), "simhash-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    linked = nodes.join(roots, "fp", "left").withColumn("_group", F.coalesce("root", F.xxhash64(F.col("fp"), F.lit(1))))
    least = linked.where("root is not null").groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(least, "root", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    named = small(stored(named, "simhash-names"), 24)  # one row a fingerprint: a common one's documents can be split
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that of its least doc_id, with all its columns."""
    row = F.xxhash64("doc_id", "text")
    made = stored(fingerprints(docs.select("doc_id", "text", row.alias("row")), "doc_id", "row"), "near-prints")
    roots = components(links(stored(made.select("fp").distinct(), "near-nodes"))).withColumnRenamed("node", "fp")
    found = made.join(small(stored(roots, "near-roots")), "fp", "left")
    found = stored(found.withColumn("_group", F.coalesce("root", F.xxhash64("fp", F.lit(1)))), "near-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_last"), F.col("doc_id"), F.col("row")))
    stays = stored(found.groupBy("_group").agg(first.alias("_first")).select("_first.row"), "near-stays")
    goes = found.select(F.col("row").alias("_gone")).distinct().join(stays, F.col("_gone") == F.col("row"), "left_anti")
    goes = small(stored(goes.select("_gone"), "near-goes"))
    kept = docs.select(packed(docs), row.alias("_id")).join(goes, F.col("_id") == F.col("_gone"), "left_anti")
    again = found.groupBy("row").count().where("count > 1").join(stays, "row", "left_semi")
    if not again.isEmpty():  # repeated rows
        kept = kept.groupBy("_id").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return kept.select("_row.*")


def op6_simhash(spark, folder: str) -> DataFrame:
    found = groups(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
