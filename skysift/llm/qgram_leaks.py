"""Benchmark decontamination by the q-gram lemma.

An item of m characters that lies in a document with at most k edits shares at
least m - q + 1 - k q of its character q-grams with it, and their diagonals
(place in the document less place in the item) differ by at most k. So a
document's q-grams are looked up among the items', hits are counted in
overlapping bands of 2 (k + 1) diagonals, bands that reach the bound are kept,
and each is verified by alignment within its diagonals.

Texts are compared in lower case (A-Z), with every white-space character as a
space. Items of over 2 x PART characters are looked for in overlapping parts of
PART characters as well, so that a long passage is found without the rest.

The benchmark is read in blocks of at most MAX_BLOCK characters, each shipped
with one pass over the documents; a larger benchmark takes more passes.

Edge cases: null and empty texts and items match nothing. Items shorter than q
characters are matched exactly. Repeated rows are reported each once, null
ids stay null. An item
that matches at several places is reported at the best one (fewest edits, then
first). Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows

Q, EDIT_RATE, PART = 7, 0.1, 200
MAX_BLOCK = 4_000_000
BITS = 22

_MULTIPLIER = np.uint32(0x9E3779B1)


#: A-Z to lower case, white space to a space; other bytes of UTF-8 stay.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz     ")


def normal(text: str) -> np.ndarray:
    """Code points in lower case, white space as spaces."""
    data = text.encode("utf-8", "surrogatepass").translate(_PLAIN)
    if len(data) == len(text):  # one byte a code point
        return np.frombuffer(data, np.uint8).astype(np.uint32)
    return np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(c: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the Q characters from every place on (by doubling)."""
    n = len(c) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    m1 = _MULTIPLIER
    m2 = np.uint32(int(m1) ** 2 & 0xFFFFFFFF)
    h2 = c[:-1] * m1 + c[1:]
    h4 = h2[:-2] * m2 + h2[2:]
    h6 = h4[:n] * m2 + h2[4 : 4 + n]  # 4 + 2
    h7 = h6 * m1 + c[6 : 6 + n]
    h7 ^= h7 >> np.uint32(15)
    h7 *= np.uint32(0x85EBCA6B)
    return h7


def budget(m: int) -> int:
    """Most edits allowed for a pattern of m characters; the lemma's bound
    stays positive."""
    return max(0, min(int(EDIT_RATE * m), (m - Q) // Q if m > Q else 0))


class Index:
    """The q-grams of a block of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.patterns, self.exact = [], [], []
        for item, text in items:
            c = normal(text)
            if len(c) < Q:
                if len(c):
                    self.exact.append((item, c))
                continue
            starts = range(0, len(c) - PART + 1, PART // 2) if len(c) > 2 * PART else []
            for p in (c, *(c[s : s + PART] for s in starts)):
                self.ids.append(item)
                self.patterns.append(p)
        hashes = [_grams(p) for p in self.patterns]
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)
        which = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes]) if hashes else np.zeros(0, int)
        place = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.zeros(0, int)
        order = np.argsort(h, kind="stable")
        self.which, self.place = which[order], place[order]
        self.hash, self.first, self.times = np.unique(h[order], return_index=True, return_counts=True)
        self.table = np.zeros(1 << BITS, bool)
        self.table[self.hash >> np.uint32(32 - BITS)] = True
        m = np.array([len(p) for p in self.patterns] or [0])
        self.k = np.array([budget(x) for x in m])
        self.need = m - Q + 1 - self.k * Q
        self.width = int((m + self.k).max())
        self.shift = self.width + 2  # no band starts further before a text
        self.least = int(self.need.min()) if len(self.patterns) else 1 << 30

    def regions(self, c: np.ndarray) -> list[tuple[int, int]]:
        """(pattern, first diagonal of a band) of every band that may match."""
        g = _grams(c)
        if not len(g) or not len(self.hash):
            return []
        hit = self.table[g >> np.uint32(32 - BITS)]
        at = np.flatnonzero(hit)
        if len(at) < self.least:
            return []
        # only places with enough hits within the longest pattern's reach
        before = np.searchsorted(at, at - self.width)
        after = np.searchsorted(at, at + self.width, side="right")
        at = at[after - before >= self.least]
        if not len(at):
            return []
        own = g[at]
        slot = np.minimum(np.searchsorted(self.hash, own), len(self.hash) - 1)
        there = self.hash[slot] == own
        at, slot = at[there], slot[there]
        if not len(at):
            return []
        lo, n = self.first[slot], self.times[slot]
        flat = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        p = self.which[flat]
        shift = self.shift  # keeps diagonals positive
        diagonal = np.repeat(at, n) - self.place[flat] + shift
        band = diagonal // (self.k[p] + 1)
        keys = np.concatenate([p * (1 << 40) + band, p * (1 << 40) + band - 1])
        keys, count = np.unique(keys, return_counts=True)
        p = keys >> 40
        keep = count >= self.need[p]
        p, band = p[keep], keys[keep] & ((1 << 40) - 1)
        return list(zip(p.tolist(), (band * (self.k[p] + 1) - shift).tolist(), strict=True))

    def search(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item -> (edits, start, end) in characters, the best place."""
        c = normal(text)
        found: dict[int, tuple[int, int, int]] = {}
        for p, first in self.regions(c):
            item, k = self.ids[p], int(self.k[p])
            if item in found and found[item][0] == 0:
                continue
            got = align(self.patterns[p], c, first, first + 2 * k + 1, k)
            if got and (item not in found or got < found[item]):
                found[item] = got
        for item, e in self.exact:
            s = c.tobytes().find(e.tobytes())
            while s >= 0 and s % 4:
                s = c.tobytes().find(e.tobytes(), s + 1)
            if s >= 0:
                found[item] = (0, s // 4, s // 4 + len(e))
        return found


def align(p: np.ndarray, c: np.ndarray, first: int, last: int, k: int) -> tuple[int, int, int] | None:
    """The best (edits, start, end) of pattern p in c within diagonals first to
    last, or None if it takes over k edits."""
    m, width = len(p), last - first + 1
    lo, hi = max(first, 0), min(last, len(c) - m)
    for d in range(lo, hi + 1):  # the text as it is
        if c[d] == p[0] and np.array_equal(c[d : d + m], p):
            return 0, d, d + m
    if k == 0:
        return None
    far = m + k + 1
    # row i holds the cells (i, j) with j - i = first .. last; the start is carried along
    slots = np.arange(width)
    column = first + slots
    cost = np.where((column >= 0) & (column <= len(c)), 0, far)
    begin = column.copy()
    padded = np.full(width + m + 1, 0xFFFFFFFF, np.uint32)
    s, e = max(first, 0), min(last + m, len(c))
    if e > s:
        padded[s - first : e - first] = c[s:e]
    for i in range(1, m + 1):
        j = first + slots + i
        step = cost + (padded[i - 1 : i - 1 + width] != p[i - 1])
        skip = np.append(cost[1:] + 1, far)  # a pattern character without a partner
        use = skip < step
        cand = np.where(use, skip, step)
        start = np.where(use, np.append(begin[1:], 0), begin)
        cand = np.where((j >= 0) & (j <= len(c)), cand, far)
        run = np.minimum.accumulate(cand - slots)  # text characters without a partner
        source = np.maximum.accumulate(np.where(cand - slots == run, slots, 0))
        cost, begin = np.minimum(run + slots, far), start[source]
        if cost.min() > k:
            return None
    best = int(cost.argmin())
    if cost[best] > k:
        return None
    return int(cost[best]), int(begin[best]), int(first + best + m)


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of at most MAX_BLOCK characters (or one
    item); only one block is on the driver at a time."""
    items = benchmark.where("text IS NOT NULL AND length(text) > 0 AND item_id IS NOT NULL").select("item_id", "text")
    block, size = [], 0
    for r in items.toLocalIterator():
        if block and size + len(r["text"]) > MAX_BLOCK:
            yield block
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if block:
        yield block


_INDEXES: dict[str, Index] = {}


def _index(key: str, items: list[tuple[int, str]]) -> Index:
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(items)
    return _INDEXES[key]


FOUND = "item_id long, edits int, start int, end int"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start, end): the items that documents hold."""
    rows = docs.select("doc_id", "text").where("text IS NOT NULL")
    out = docs.sparkSession.createDataFrame([], f"doc_id long, {FOUND}")
    for block in blocks(benchmark):
        key = hashlib.md5(repr(block).encode()).hexdigest()

        def run(parts: Iterator[pd.DataFrame], key=key, block=block) -> Iterator[pd.DataFrame]:
            index = _index(key, block)
            for part in parts:
                found = [(d, i, *got) for d, t in zip(part["doc_id"], part["text"], strict=True) for i, got in sorted(index.search(t).items())]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "edits", "start", "end"])

        out = out.unionByName(map_rows(rows, run, FOUND))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item. A document's verdict is made where it is
    read, block by block, so nothing is shuffled and no column changes."""
    out = docs
    for block in blocks(benchmark):
        key = hashlib.md5(repr(block).encode()).hexdigest()

        def run(parts: Iterator[pa.RecordBatch], key=key, block=block) -> Iterator[pa.RecordBatch]:
            index = _index(key, block)
            for part in parts:
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                yield part.filter(pa.array([not (t and index.search(t)) for t in texts], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out


def op6(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)
