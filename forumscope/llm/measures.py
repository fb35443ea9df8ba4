"""Measures of a text's form, one pass over its words, shared by the quality operators."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forumscope.llm.common import map_arrow

MARKS = re.compile(r"[#*$%&|<>]")

#: Name and type of each measure, in the order that ``measure`` returns them.
MEASURES = {
    "n_words": "bigint",
    "word_chars": "bigint",
    "n_symbols": "bigint",
    "n_dup_lines": "bigint",
    "n_repeat_words": "bigint",
    "n_lines": "bigint",
    "n_distinct": "bigint",
    "n_plain": "bigint",
    "n_stops": "bigint",
}


def numbered(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    """Each word's number, in order of first use."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    return ids, numbers


def repeated_words(ids: np.ndarray, base: int) -> int:
    """Words inside three-word windows that occur twice or more; ``base``: the number of different words."""
    if len(ids) < 4:
        return 0
    if base < 1 << 20:  # three ids fit into 60 bits
        windows = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:  # number the pairs first, so that any length is exact
        _, pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)
        windows = pairs[:-1].astype(np.int64) * base + ids[2:]
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(windows), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(windows)] |= twice
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """All measures of one text; null is a text without words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    seen: set[str] = set()
    dup = with_word = 0
    for line in lines:
        if line.strip(" \t\n\r\x0b\x0c"):
            with_word += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    blanks = sum(map(text.count, " \t\n\r\x0b\x0c"))
    ids, numbers = numbered(words)
    times = np.bincount(ids, minlength=len(numbers))
    plain = times[[w.decode("utf-8", "replace").rstrip(".,;:!?").isalpha() for w in numbers]].sum() if words else 0
    stops = times[[w[-1] in b".!?" for w in numbers]].sum() if words else 0
    repeat, marks = repeated_words(ids, len(numbers)), len(MARKS.findall(text))
    return len(words), len(text) - blanks, marks, dup, repeat, with_word, len(numbers), int(plain), int(stops)


def measured(docs: DataFrame, *carry: str) -> DataFrame:
    """The carried columns beside the measures of every text; other columns are dropped."""
    fields = {f.name: f.dataType.simpleString() for f in docs.select(*carry).schema.fields}
    schema = ", ".join(f"`{n}` {t}" for n, t in (fields | MEASURES).items())

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            made = [measure(t.as_py()) for t in batch.column("text")]
            columns = list(zip(*made, strict=True)) or [()] * len(MEASURES)
            return {c: batch.column(c) for c in carry} | dict(zip(MEASURES, columns, strict=True))

        return work

    return map_arrow(docs.select(*carry, F.col("text")), schema, make)
