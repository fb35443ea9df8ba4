"""Removal of repeated byte strings with a distributed, sampled suffix array.

A byte goes if it is covered by a ``LENGTH``-byte string (window) that also starts anywhere else in the corpus. Sorting the suffix
of every byte would multiply the corpus by the length of a suffix, so suffixes are sampled by content: the anchor of a
window is its least 32-byte token by hash, the leftmost if equal. Equal windows have their anchors at the same offset, so only
the suffixes at anchors have to meet, one in about 185 bytes. Each stands for the windows that it is the anchor of: a run
of starts, and the context that these windows cover.

1. Anchors whose leading token is unique are done: none of their windows repeats.
2. Contexts that are equal byte for byte (grouped by hash, combined before the shuffle) repeat in all their windows,
   however many copies there are, and go on as one.
3. Different contexts with one leading token are what is left, around the ends of repeated passages. Sampled splitters range-partition them by
   their leading token, so what can match shares a bucket and buckets never have to look across a boundary. A
   bucket sorts the suffixes, and the reversed prefixes, by multikey quicksort with eight-byte keys, which gives
   the longest common prefix of neighbours. For each offset of the anchor, windows are equal if they lie in one run of both orders.
4. A leading token with more than ``CROWD`` different contexts would overfill its bucket. Its windows are compared across
   all buckets instead, as rows of window hashes, counted with a combine before the shuffle.

A removed interval is a row; texts move twice, to the contexts that are compared and to the intervals that go, at every size alike.

Defined results: a null text has no bytes; texts shorter than a window keep everything; windows never cross documents, overlaps count, and
everything is judged on the input; a repeated row is another place for each of its strings; rows with one doc_id and different texts
are told apart by their text; a null doc_id is carried; texts of any length are read whole, in segments; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from forumscope.llm.common import map_arrow, stored, table

LENGTH = 400
TOKEN = 32
SPAN = LENGTH - TOKEN + 1  # tokens in a window
CROWD = 20_000
BUCKET = 20_000
CHUNK = 1 << 20
SEGMENT = 8 << 20
PLACE_BITS = 24

MULTIPLIER = 0x9E3779B97F4A7C15
MIXER = 0xFF51AFD7ED558CCD


def token_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the token that starts at each byte, by doubling."""
    h, width, factor = data.astype(np.uint64) + np.uint64(1), 1, MULTIPLIER
    while width < TOKEN:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = width * 2, factor * factor % (1 << 64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(MIXER)
    h ^= h >> np.uint64(32)
    return h


def least_in_windows(values: np.ndarray, span: int = SPAN) -> np.ndarray:
    """The least of each ``span`` consecutive values, by doubling."""
    width = 1
    while 2 * width <= span:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (span - width)], values[span - width :]) if span > width else values


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, first and last window start, and token hash of each run of windows, by place.

    ``data``: texts one after the other, at most ``SEGMENT`` and a window long in all; ``ends``: where each ends.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    hashes = token_hashes(data)
    place = np.arange(len(hashes), dtype=np.uint64)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = least_in_windows(hashes & ~mask | place)
    end = np.repeat(ends, np.diff(ends, prepend=0))[: len(least)]
    starts = np.nonzero(end - np.arange(len(least)) >= LENGTH)[0]
    if not len(starts):
        return none, none, none, none.astype(np.uint64)
    at = (least[starts] & mask).astype(np.int64)
    first = np.nonzero(np.diff(at, prepend=-1))[0]
    last = np.append(first[1:], len(at)) - 1
    return at[first], starts[first], starts[last], hashes[at[first]]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column one after the other, and where each text starts and ends."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Ranges of texts that are read together, as first and last byte and the ends within; long texts in segments."""
    row, n = 0, len(offsets) - 1
    while row < n:
        low = offsets[row]
        stop = max(row + 1, int(np.searchsorted(offsets, low + CHUNK, side="right")) - 1)
        high = offsets[stop]
        if high - low <= SEGMENT:
            yield low, high, offsets[row + 1 : stop + 1] - low
        else:
            for at in range(low, high, SEGMENT):
                end = min(high, at + SEGMENT + LENGTH - 1)  # the starts of the next segment follow
                yield at, end, np.array([end - at])
        row = stop


def anchor_table(docs: DataFrame) -> DataFrame:
    """row, anchor, first and last window start, token hash and context hash of every sampled suffix."""

    def make():
        def work(batch: pa.RecordBatch) -> dict | None:
            data, offsets = _flat(batch.column("text"))
            made = []
            for low, high, ends in _pieces(offsets):
                part = data[low:high]
                at, first, last, token = anchors(part, ends)
                if len(at):
                    view = part.tobytes()
                    context = np.fromiter(
                        (
                            xxhash.xxh3_64_intdigest(view[f : e + LENGTH], a - f)
                            for a, f, e in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)
                        ),
                        dtype=np.uint64,
                        count=len(at),
                    )
                    made.append((at + low, first + low, last + low, token, context))
            if not made:
                return None
            at, first, last, token, context = (np.concatenate(x) for x in zip(*made, strict=True))
            text = np.searchsorted(offsets, at, side="right") - 1
            begin = offsets[text]
            return {
                "row": batch.column("row").take(pa.array(text)),
                "at": pa.array((at - begin).astype(np.int32)),
                "first": pa.array((first - begin).astype(np.int32)),
                "last": pa.array((last - begin).astype(np.int32)),
                "token": pa.array(token.view(np.int64)),
                "context": pa.array(context.view(np.int64)),
            }

        return work

    schema = "row bigint, at int, first int, last int, token bigint, context bigint"
    return map_arrow(docs.select("row", "text"), schema, make)


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def context_bytes(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """The bytes before and from the anchor of each context; one place of it is enough."""
    places = contexts.groupBy(F.col("row").alias("_row")).agg(
        F.collect_list(F.struct("at", "first", "last", "single", "crowded")).alias("places")
    )
    found = docs.join(places, F.col("row") == F.col("_row"))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = {n: [] for n in ("row", "at", "first", "last", "single", "crowded", "before", "suffix")}
            rows, texts = batch.column("row").to_pylist(), batch.column("text").cast(pa.large_binary())
            seen = set()
            for row, text, places in zip(rows, texts, batch.column("places").to_pylist(), strict=True):
                if row in seen:  # a repeated row
                    continue
                seen.add(row)
                text = text.as_py() or b""
                for p in places:
                    out["row"].append(row)
                    for n in ("at", "first", "last", "single", "crowded"):
                        out[n].append(p[n])
                    out["before"].append(text[p["first"] : p["at"]])
                    out["suffix"].append(text[p["at"] : p["last"] + LENGTH])
            return out

        return work

    schema = "row bigint, at int, first int, last int, single boolean, crowded boolean, before binary, suffix binary"
    return map_arrow(found.select("row", "text", "places"), schema, make)


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of eight-byte keys, and the common bytes of each with the one before it.

    Most significant key first; only rows that are equal so far are looked at again.
    """
    n, width = words.shape
    order = np.arange(n)
    starts = np.zeros(n + 1, dtype=bool)
    starts[0] = starts[n] = True
    common = np.full(n, 8 * width)
    common[0] = 0
    for key in range(width):
        tied = np.nonzero(~(starts[:-1] & starts[1:]))[0]
        if not len(tied):
            break
        run = np.cumsum(starts[:-1])[tied]
        value = words[order[tied], key]
        sort = np.lexsort((value, run))
        order[tied] = order[tied][sort]
        value = value[sort]
        split = (run[1:] == run[:-1]) & (value[1:] != value[:-1])
        places = tied[1:][split]
        differ = (value[1:] ^ value[:-1])[split].astype(">u8").view(np.uint8).reshape(-1, 8)
        common[places] = 8 * key + (differ != 0).argmax(axis=1)
        starts[places] = True
    return order, common


def _keys(parts: list[bytes], width: int) -> np.ndarray:
    flat = b"".join(p.ljust(width, b"\0") for p in parts)
    return np.frombuffer(flat, dtype=">u8").reshape(len(parts), -1).astype(np.uint64)


def repeated_windows(before: list[bytes], suffix: list[bytes]) -> np.ndarray:
    """For each offset of the anchor and each context: whether its window there equals another context's window."""
    n = len(suffix)
    right, right_common = multikey_sort(_keys(suffix, LENGTH))
    left, left_common = multikey_sort(_keys([b[::-1] for b in before], -(-SPAN // 8) * 8))
    most = np.fromiter(map(len, before), dtype=np.int64, count=n)
    least = LENGTH - np.fromiter(map(len, suffix), dtype=np.int64, count=n)
    found = np.zeros((SPAN, n), dtype=bool)
    of_right, of_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(SPAN):
        here = np.nonzero((least <= offset) & (offset <= most))[0]
        if len(here) < 2:
            continue
        of_right[right] = np.cumsum(right_common < LENGTH - offset)
        of_left[left] = np.cumsum(left_common < offset)
        both = of_right[here] * (n + 1) + of_left[here]
        sort = np.argsort(both, kind="stable")
        same = both[sort][1:] == both[sort][:-1]
        found[offset, here[sort[1:][same]]] = True
        found[offset, here[sort[:-1][same]]] = True
    return found


def _runs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column, first and last row of each run of set cells in a column."""
    edges = np.diff(np.pad(found.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    column, first = np.nonzero(edges == 1)
    return column, first, np.nonzero(edges == -1)[1] - 1


def bucket_intervals(contexts: DataFrame) -> DataFrame:
    """row, low and high of what repeats in the contexts of each leading token, bucket by bucket."""
    count = contexts.count()
    lead = F.substring(F.col("suffix"), 1, TOKEN)
    buckets = contexts.repartitionByRange(max(1, -(-count // BUCKET)), lead)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is not None:
            found = repeated_windows(table["before"].to_pylist(), table["suffix"].to_pylist())
            found &= table["single"].to_numpy()[None, :]
            column, first, last = _runs(found)
            at = table["at"].to_numpy().astype(np.int64)[column]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(table["row"].to_numpy()[column]),
                    pa.array((at - last).astype(np.int32)),
                    pa.array((at - first + LENGTH).astype(np.int32)),
                ],
                names=["row", "low", "high"],
            )

    return buckets.mapInArrow(run, "row bigint, low int, high int")


def crowd_intervals(contexts: DataFrame) -> DataFrame:
    """The same for leading tokens with too many contexts for a bucket: all windows, counted by hash."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            rows, starts, a, b = [], [], [], []
            for row, first, before, suffix in zip(
                *(batch.column(c).to_pylist() for c in ("row", "first", "before", "suffix")), strict=True
            ):
                text = before + suffix
                for start in range(len(text) - LENGTH + 1):
                    digest = xxhash.xxh3_128_digest(text[start : start + LENGTH])
                    rows.append(row)
                    starts.append(first + start)
                    a.append(int.from_bytes(digest[:8], "little", signed=True))
                    b.append(int.from_bytes(digest[8:], "little", signed=True))
            return {"row": rows, "low": starts, "a": a, "b": b}

        return work

    windows = map_arrow(contexts.select("row", "first", "before", "suffix"), "row bigint, low int, a bigint, b bigint", make)
    windows = stored(windows, "suffix-windows")
    twice = windows.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return windows.join(twice, ["a", "b"], "left_semi").select("row", "low", (F.col("low") + LENGTH).alias("high"))


def intervals(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """row, low and high (exclusive) of byte ranges that go; ``docs``: row and text."""
    sampled = stored(anchor_table(docs), "suffix-anchors")
    contexts = stored(
        sampled.groupBy("token", "context").agg(
            F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("row", "at", "first", "last")]
        ),
        "suffix-contexts",
    )
    copied = contexts.where("n > 1").select(F.col("token").alias("_t"), F.col("context").alias("_c"))
    whole = sampled.join(copied, (F.col("token") == F.col("_t")) & (F.col("context") == F.col("_c")), "left_semi")
    whole = whole.select("row", F.col("first").alias("low"), (F.col("last") + LENGTH).alias("high"))
    leads = contexts.groupBy("token").agg(F.count("*").alias("m"), F.min("n").alias("_least"))
    leads = stored(leads.where("m > 1 and _least = 1").select("token", (F.col("m") > crowd).alias("crowded")), "suffix-leads")
    partial = contexts.join(leads, "token").withColumn("single", F.col("n") == 1)
    partial = stored(context_bytes(docs, partial), "suffix-bytes")
    found = whole.union(bucket_intervals(partial.where("not crowded")))
    crowded = partial.where("crowded")
    if not crowded.isEmpty():
        found = found.union(crowd_intervals(crowded))
    return stored(found, "suffix-intervals")


def remove(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, the text's bytes, the removed ranges (array of low and high) and the bytes that are left."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    rows = docs.select("doc_id", "text", _row().alias("row"))
    gone = intervals(rows.select("row", "text"), crowd).groupBy(F.col("row").alias("_row"))
    gone = stored(gone.agg(F.collect_list(F.struct("low", "high")).alias("gone")), "suffix-gone")
    joined = rows.join(gone, F.col("row") == F.col("_row"), "left")

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            sizes, spans, kept = [], [], []
            for text, gone in zip(batch.column("text").cast(pa.large_binary()), batch.column("gone"), strict=True):
                text = text.as_py() or b""
                merged: list[list[int]] = []
                if gone.is_valid and len(gone):
                    fields = gone.values
                    low, high = (fields.field(i).to_numpy() for i in (0, 1))
                    for i in np.lexsort((high, low)).tolist():
                        if merged and low[i] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], int(high[i]))
                        else:
                            merged.append([int(low[i]), int(high[i])])
                sizes.append(len(text))
                spans.append([{"low": a, "high": b} for a, b in merged])
                ends = [0, *(x for span in merged for x in span), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            return {"doc_id": batch.column("doc_id"), "n_bytes": sizes, "spans": spans, "kept": kept}

        return work

    schema = f"doc_id {kind}, n_bytes bigint, spans array<struct<low: int, high: int>>, kept binary"
    return map_arrow(joined.select("doc_id", "text", "gone"), schema, make)


def op8_suffix(spark, folder: str) -> DataFrame:
    return remove(table(spark, folder, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),  # a cut may leave part of a character
    )
