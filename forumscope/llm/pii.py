"""Personal data by patterns and a skip-chain conditional random field.

The patterns find e-mail addresses, IP addresses, card and phone numbers; these base spans always stay. Written
again in the same document, a number may lack its plus sign or be grouped otherwise, and an address may be spelled out.
Such candidates are nodes of a conditional random field over the document, as the base spans are. Its labels are the four
kinds and none. A candidate's own potential is the log chance of each label given its shape, counted over the whole corpus;
a base span's label is fixed. Neighbouring candidates share a weak potential, and skip edges join distant ones that repeat
or resemble each other (equal or equally ending digits, equal name before the at sign) with a strong one. Loopy
belief propagation passes messages until they settle; a candidate whose kind is likelier than ``LEAST`` is added.

Edges stay linear: the occurrences of a key are chained in text order and to the key's first base span, no pair of all
occurrences is formed. Texts are read once; only spans and keys travel, and belief propagation runs for the documents that have a skip
edge to a base span. Shapes are a few hundred whatever the corpus, so their counts are a small table.

Defined results: a null text is empty and has no spans; texts of any length are read whole, in linear time; a null doc_id is
carried; repeated rows give a row each; an empty table gives an empty result; other columns are ignored. Positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from forumscope.llm.common import map_arrow, stored, table

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "none")
LEAST = 0.5
SKIP, CHAIN = 4.0, 0.3
TAIL = 8
ROUNDS = 50

# The given patterns of the base kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = re.compile(r"[0-9]")
NAME = re.compile(r"[A-Za-z0-9._%+-]*\Z")
NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
SPELLED = re.compile(r"([A-Za-z0-9._%+-]{3,64})(?: ?[\[(]?at[\])]? ?| at )([A-Za-z0-9-]+(?: ?[\[(]?dot[\])]? ?| dot |\.)[A-Za-z]{2,})\b")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """The address around each at sign: the longest name before it that follows the last match, and a domain."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end:
            low = max(end, at - 64)
            start = NAME.search(text, low, at).start()
            while start == low > end:  # a longer name: look further back
                low = max(end, low - 4 * (at - low))
                start = NAME.search(text, low, at).start()
            domain = DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                end = domain.end()
                found.append(("email", start, end))
        at = text.find("@", at + 1)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = int(c) * (1 + place % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def small_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, by kind and start."""
    found = emails(text) if "@" in text else []
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        if all(map(small_part, m[0].split("."))):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits_of(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def keyed(kind: str, text: str) -> str:
    """What equal or similar candidates share: the last digits, or the name before the at sign."""
    if kind == "email":
        return "@" + re.split(r"@|[\[(]?\bat\b[\])]?| at ", text, maxsplit=1)[0].strip().lower()
    digits = digits_of(text)
    return "." + digits if kind == "ip" else "#" + digits[-TAIL:]


def shaped(text: str) -> str:
    """A candidate's form: letters or digits, how many digits, and in how many groups."""
    digits = len(digits_of(text))
    if digits < 5:
        return "word"
    groups = len(re.findall(r"[0-9]+", text))
    return f"{min(digits, 24)}d{min(groups, 6)}g"


def candidates(text: str) -> list[tuple[str, int, int, str, str]]:
    """All nodes of a text in order: kind (empty if not a base span), start, end, key, shape."""
    base = base_spans(text)
    nodes = [(k, s, e, keyed(k, text[s:e]), shaped(text[s:e].lstrip("+"))) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    starts, ends = np.array([s for s, _ in taken], int), np.array([e for _, e in taken], int)
    ends = np.maximum.accumulate(ends) if len(ends) else ends

    def free(start: int, end: int) -> bool:
        before = int(np.searchsorted(starts, end)) - 1
        return before < 0 or ends[before] <= start

    if any(k != "email" for k, _, _ in base):  # a number can only be confirmed by one of the base spans
        for m in NUMBER.finditer(text):
            size = len(digits_of(m[0])) if m.end() - m.start() >= TAIL - 1 else 0
            if TAIL - 1 <= size <= 19 and free(m.start(), m.end()):
                nodes.append(("", m.start(), m.end(), keyed("phone", m[0]), shaped(m[0])))
    if any(k == "email" for k, _, _ in base):
        for m in SPELLED.finditer(text):
            if free(m.start(), m.end()):
                nodes.append(("", m.start(), m.end(), keyed("email", m[1]), shaped(m[0])))
    return sorted(nodes, key=lambda n: (n[1], n[2]))


def beliefs(unary: np.ndarray, edges: list[tuple[int, int, float]], rounds: int = ROUNDS) -> np.ndarray:
    """Loopy sum-product with damping: each node's chance of each label.

    ``unary``: log potentials; an edge adds its weight to the log potential of equal labels.
    """
    if not edges:
        messages = np.zeros((0, unary.shape[1]))
    a = np.array([e[0] for e in edges] + [e[1] for e in edges], dtype=int)
    b = np.array([e[1] for e in edges] + [e[0] for e in edges], dtype=int)
    same = np.exp(np.array([e[2] for e in edges] * 2, dtype=float))[:, None]
    messages = np.zeros((len(a), unary.shape[1]))
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))]).astype(int)
    for _ in range(rounds if edges else 0):
        total = unary.copy()
        np.add.at(total, b, messages)
        out = total[a] - messages[back]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        fresh = np.log(out.sum(axis=1, keepdims=True) + (same - 1) * out)
        fresh = 0.5 * messages + 0.5 * (fresh - fresh.max(axis=1, keepdims=True))
        moved = np.abs(fresh - messages).max()
        messages = fresh
        if moved < 1e-6:
            break
    total = unary.copy()
    np.add.at(total, b, messages)
    chance = np.exp(total - total.max(axis=1, keepdims=True))
    return chance / chance.sum(axis=1, keepdims=True)


def label(nodes: list[tuple[str, int, int, str, str]], shapes: dict[str, list[float]]) -> list[Span]:
    """The spans that belief propagation adds to the base spans of one document."""
    groups: dict[str, list[int]] = {}
    for i, node in enumerate(nodes):
        groups.setdefault(node[3], []).append(i)
    live = [g for g in groups.values() if any(nodes[i][0] for i in g) and any(not nodes[i][0] for i in g)]
    if not live:
        return []
    flat = [math.log(0.2)] * len(LABELS)
    unary = np.array([shapes.get(n[4], flat) for n in nodes])
    for i, node in enumerate(nodes):
        if node[0]:
            unary[i] = [0.0 if k == node[0] else -50.0 for k in LABELS]
    edges = {(i, i + 1): CHAIN for i in range(len(nodes) - 1)}
    for group in groups.values():
        first = next((i for i in group if nodes[i][0]), None)
        for i, j in zip(group, group[1:], strict=False):
            edges[i, j] = SKIP
        for i in group if first is not None else ():
            if i != first:
                edges[min(i, first), max(i, first)] = SKIP
    chance = beliefs(unary, [(i, j, w) for (i, j), w in edges.items()])
    best = chance.argmax(axis=1)
    added = {i for g in live for i in g if not nodes[i][0]}
    return [
        (LABELS[best[i]], nodes[i][1], nodes[i][2])
        for i in sorted(added)
        if LABELS[best[i]] != "none" and chance[i, best[i]] > LEAST
    ]


def joined(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
    return ",".join(f"{k}:{s}:{e}" for k, s, e in order)


NODES = "nodes array<struct<kind: string, start: int, end: int, key: string, shape: string>>"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans' count by kind, base_sha256, all spans, and how many were added."""
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    names = ("kind", "start", "end", "key", "shape")

    def scan():
        def work(batch: pa.RecordBatch) -> dict:
            made = [candidates(t.as_py() or "") for t in batch.column("text")]
            return {"doc_id": batch.column("doc_id"), "nodes": [[dict(zip(names, n, strict=True)) for n in d] for d in made]}

        return work

    found = stored(map_arrow(docs.select("doc_id", "text"), f"doc_id {kind}, {NODES}", scan), "pii-nodes")
    node = found.select(F.explode("nodes").alias("n")).select("n.shape", "n.kind")
    shapes: dict[str, list[float]] = {}
    for r in node.groupBy("shape", "kind").count().collect():  # a few hundred shapes at most
        row = shapes.setdefault(r["shape"], [0.5] * len(LABELS))
        row[LABELS.index(r["kind"] or "none")] += r["count"]
    # Numbers that are not base spans are not known to be free of personal data, so they weigh half.
    for row in shapes.values():
        row[-1] *= 0.5
        total = sum(row)
        row[:] = [max(math.log(n / total), -3.0) for n in row]

    def decide():
        def work(batch: pa.RecordBatch) -> dict:
            out = {c: [] for c in (*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added")}
            for nodes in batch.column("nodes").to_pylist():
                nodes = [tuple(n[c] for c in names) for n in nodes]
                base = [n[:3] for n in nodes if n[0]]
                added = label(nodes, shapes) if len(base) < len(nodes) else []
                for k in KINDS:
                    out[f"n_{k}"].append(sum(b[0] == k for b in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + added))
                out["n_added"].append(len(added))
            return {"doc_id": batch.column("doc_id")} | out

        return work

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_arrow(found, f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_added bigint", decide)


def op4_pii(spark, folder: str) -> DataFrame:
    return find(table(spark, folder, "documents"))
