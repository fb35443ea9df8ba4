"""Hierarchical multi-length packing of documents into token sequences.

Tiers are context sizes, powers of two up to the longest window. A document gives full windows of the longest tier; its
tail, or a shorter document, is routed to the smallest tier that holds it and waits there. Windows are opened for the
longest waiting piece, in a window of its tier, and the gap is filled with the longest waiting pieces that fit, which come from
this tier or shorter ones. If none fits, one is cut to the gap and its rest is routed anew. So a window is
full when it closes. What waits at the end of a task fills windows of falling powers of two, so no sequence is padded.

Sequences of one tier are dealt to step groups of ``STEP_TOKENS`` tokens: eight windows of 2,048 or sixty-four of 256, the same
work in each step.

Packing runs where the scan has put the documents: nothing is shuffled, and a task holds at most ``WAITING`` waiting pieces
besides its current batch. A sequence's id is the task's number and a counter, so a task that is run again gives the same rows.

Token ids come from a tokenizer file, piece by piece with a bounded memory: its splitting never crosses white space, so what stands
between blanks can be encoded alone. Every document ends with ``END_ID``.

Defined results: a null or empty text is the end id alone; a null doc_id is carried; repeated rows are packed each; very long texts
are cut into windows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from forumscope.llm.common import table

END_ID = 1
WINDOW = 2048
TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 8 * WINDOW
WAITING = 512
CACHE = 600_000

PIECES = (
    "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "tier int, step_group bigint"
)

Piece = tuple[int, int, int, bytes, int]  # length, row order, start, ids, tokens of the document


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Text of these characters, in lower case, is split as the tokenizer splits it: the pattern below is its own, over letters of
#: one code point that neither composing nor lower-casing can change otherwise.
SIMPLE = re.compile(r"[\n !-~\u00c0-\u012f\u0131-\u017f]*")
PIECE = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^\n a-z0-9\u00df-\u00f6\u00f8-\u017f]+"
)
SPECIAL = "<|"


@lru_cache(maxsize=1)
def encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """A function from texts to their ids as little-endian unsigned 32-bit numbers.

    A text is cut into pieces (a run of letters, a digit, a run of marks), or between blanks where it holds other
    characters, and a bounded memory keeps the ids of each, so that the tokenizer sees a piece once. A Python worker keeps
    its function from task to task, with the memory.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    known: dict[str, bytes] = {}
    ends = np.zeros(tokenizer.get_vocab_size(), dtype=bool)  # ids that end a piece
    ends[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def simple(text: str) -> bool:
        return SIMPLE.fullmatch(text) is not None and SPECIAL not in text

    def parts_of(text: str, plain: bool) -> list[str]:
        if plain:
            return PIECE.findall(text.lower())
        words = text.replace("\n", " ").split(" ")
        return [p for w in words for p in (PIECE.findall(w.lower()) if simple(w) else (w,))]

    def learn(new: set[str], rest: list[str]) -> None:
        pieces = list(new.difference(rest))
        for at in range(0, len(pieces), 1_000):  # each is one run for the tokenizer: encode many, cut at the ends
            some = pieces[at : at + 1_000]
            ids = np.array(tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            flat, cuts = ids.tobytes(), ((np.nonzero(ends[ids])[0] + 1) * 4).tolist()
            known.update(zip(some, (flat[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
        made = tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        known.update((p, np.array(e.ids, dtype="<u4").tobytes()) for p, e in zip(rest, made, strict=True))

    def encode(texts: list[str]) -> list[bytes]:
        plain = [simple(t) for t in texts]
        split = [parts_of(t, p) for t, p in zip(texts, plain, strict=True)]
        used = set().union(*split)
        new = used.difference(known)
        if len(known) + len(new) > CACHE:
            known.clear()
            new = used
        learn(new, [] if all(plain) else [p for p in new if not simple(p)])
        return [b"".join(map(known.__getitem__, parts)) for parts in split]

    return encode


class Packer:
    """Packs the documents of one task; closed sequences are collected as rows."""

    def __init__(self, task: int, window: int = WINDOW, tiers: tuple[int, ...] = TIERS, waiting: int = WAITING):
        self.window, self.tiers, self.most = window, tiers, waiting
        self.base, self.count, self.order = task << 32, 0, 0
        self.waiting: list[Piece] = []
        self.ids: dict[int, object] = {}
        self.held: dict[int, int] = {}
        self.steps: dict[int, int] = {}
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: object, ids: bytes) -> None:
        total, order = len(ids) // 4, self.order
        self.order += 1
        self.ids[order], self.held[order] = doc_id, 1
        full = total // self.window * self.window
        for start in range(0, full, self.window):
            self._close([(self.window, order, start, ids[4 * start : 4 * (start + self.window)], total)])
        if full < total:
            self._wait((total - full, order, full, ids[4 * full :], total))
        self._let_go(order)
        while len(self.waiting) > self.most and self._pack():
            pass

    def finish(self) -> None:
        while self.waiting and self._pack():
            pass
        while self.waiting:  # less than the largest window is left
            self._fill(1 << (self.tokens.bit_length() - 1))

    def _wait(self, piece: Piece) -> None:
        insort(self.waiting, piece, key=lambda p: p[:3])
        self.held[piece[1]] += 1
        self.tokens += piece[0]

    def _take(self, at: int) -> Piece:
        piece = self.waiting.pop(at)
        self.tokens -= piece[0]
        return piece

    def _let_go(self, order: int) -> None:
        self.held[order] -= 1
        if not self.held[order]:
            del self.held[order], self.ids[order]

    def _pack(self) -> bool:
        """Fill a window for the longest waiting piece, if enough tokens wait."""
        longest = self.waiting[-1][0]
        tier = next((t for t in self.tiers if t >= longest), self.window)
        if self.tokens < tier:
            return False
        self._fill(tier)
        return True

    def _fill(self, size: int) -> None:
        pieces, gap = [], size
        while gap:
            at = bisect_right(self.waiting, gap, key=lambda p: p[0])
            piece = self._take(at - 1 if at else 0)
            length, order, start, ids, total = piece
            if length > gap:  # the shortest is too long: cut it, its rest waits in the tier of its length
                pieces.append((gap, order, start, ids[: 4 * gap], total))
                self._wait((length - gap, order, start + gap, ids[4 * gap :], total))
                gap = 0
            else:
                pieces.append(piece)
                gap -= length
        self._close(pieces)
        for piece in pieces:
            self._let_go(piece[1])

    def _close(self, pieces: list[Piece]) -> None:
        size = sum(p[0] for p in pieces)
        sequence = self.base + self.count
        self.count += 1
        place = self.steps.get(size, 0)
        self.steps[size] = place + 1
        step = self.base + place * size // STEP_TOKENS
        offset = 0
        for length, order, start, ids, total in pieces:
            self.rows.append((self.ids[order], start, length, zlib.crc32(ids), total, sequence, offset, size, step, ids))
            offset += length


def pack(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, its place in document and sequence, its ids' checksum, and its ids if asked for."""
    path = path or tokenizer_path()
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, {PIECES}" + ", ids array<int>" * with_ids
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def rows_of(packer: Packer) -> Iterator[pa.RecordBatch]:
        made, packer.rows = packer.rows, []
        for at in range(0, len(made), 2_000):
            part = list(zip(*made[at : at + 2_000], strict=True))
            columns = [pa.array(values, type=f.type) for values, f in zip(part[:9], out, strict=False)]
            if with_ids:
                flat = np.frombuffer(b"".join(part[9]), dtype="<i4")
                ends = np.cumsum([0, *map(len, part[9])]) // 4
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)).cast(out[9].type))
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), Packer(TaskContext.get().partitionId())
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encode(texts), strict=True):
                    packer.add(doc_id, ids + end)
                yield from rows_of(packer)
        packer.finish()
        yield from rows_of(packer)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op5_packing(spark, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), with_ids=False)
