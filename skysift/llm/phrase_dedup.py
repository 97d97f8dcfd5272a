"""Substring dedup with repeated-phrase automata.

A window is WINDOW consecutive words. Its anchor is the phrase of PHRASE words
in it whose hash is smallest (the leftmost of equals), so windows with the same
words have the same anchor at the same place. An anchor's context is all that
its windows can reach.

1. Every anchor sends its context's hash, its phrase in words and its document's
   bucket; one shuffle by the anchor's phrase. A context that comes twice confirms its phrase and all
   windows of its anchor. A phrase that comes with several contexts makes its lone
   contexts doubtful: their windows may repeat in part.
2. Windows of doubtful anchors, and of one copy of each context beside them, are
   counted by their own hashes; those found twice are confirmed, and their phrase.
3. Documents are dealt to buckets of about BUCKET_CHARS characters, and every
   confirmed phrase is sent to the buckets in which it stands. Each bucket is a
   shard: an Aho-Corasick automaton of its confirmed phrases is compiled and all
   of its documents are streamed through it. Its hits alone say where to look:
   only the words around a hit are hashed, and only windows whose anchor was hit
   are held against what was confirmed; the words that confirmed windows cover go.

Shards are buckets of documents and not of phrases, as each document would have
to pass through every shard of phrases, and both grow with the corpus. Shuffled
are hashes and, twice, the texts by bucket; the number of buckets grows with the
corpus, and a task holds one bucket. No phrase's list is gathered: rows are
sorted and compared with their neighbours, as a stream.

Words are runs without U+0020 and U+0009 to U+000D, unchanged. Edge cases: null,
empty and blank texts have no words (the digest of the empty text); texts of
under WINDOW words lose nothing. Repeated rows repeat each other's windows,
null ids stay null.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .common import ids_as_long, ids_as_text, stored

WINDOW, PHRASE = 35, 6
REACH = WINDOW - PHRASE  # words on either side of a phrase that its windows reach
CONTEXT = PHRASE + 2 * REACH
BUCKET_CHARS = 4_000_000

#: Marks of a context in a bucket, by bits.
WHOLE, DOUBTFUL, PARTNER, WINDOW_MARK = 1, 2, 4, 8

_U = np.uint64
_PLACE = _U((1 << 24) - 1)
#: Windows whose anchors are sought at a time; places within fit _PLACE.
STEP = 1 << 22
_EDGE = np.full(REACH, 0x5851F42D4C957F2D, _U)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Anchors:
    """The anchors of a document: at (places), phrase and context hashes, and
    of (the anchor number of every window)."""

    __slots__ = ("at", "phrase", "context", "of", "h")

    def __init__(self, h: np.ndarray):
        self.h = h
        n = len(h) - WINDOW + 1
        g = wordhash.windows(h, PHRASE)
        place = np.concatenate([lo + self.places(g[lo : min(lo + STEP, n) + REACH]) for lo in range(0, n, STEP)])
        new = np.append(True, place[1:] != place[:-1])
        self.at = place[new]
        self.of = np.cumsum(new) - 1
        self.phrase = g[self.at]
        self.context = wordhash.windows(np.concatenate([_EDGE, h, _EDGE]), CONTEXT)[self.at]

    @staticmethod
    def places(g: np.ndarray) -> np.ndarray:
        """The place of the least phrase of every window over g."""
        m = (g & ~_PLACE) | np.arange(len(g), dtype=_U)
        n, width, size = len(g) - REACH, REACH + 1, 1
        while size * 2 <= width:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        m = np.minimum(m[:n], m[width - size : width - size + n])
        return (m & _PLACE).astype(np.int64)

    def windows(self) -> np.ndarray:
        return wordhash.windows(self.h, WINDOW)


def _member(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of x are among sorted values."""
    if not len(among):
        return np.zeros(len(x), bool)
    at = np.searchsorted(among, x)
    at[at == len(among)] = 0
    return among[at] == x


def _bucketed(docs: DataFrame, n: int) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.pmod(F.xxhash64("doc_id", text), F.lit(n)).cast("int").alias("b"))


def _spelled(data: bytes, starts: np.ndarray, at: int) -> str:
    """The phrase that begins with word at, its words joined by one space."""
    end = int(starts[at + PHRASE]) if at + PHRASE < len(starts) else len(data)
    return b" ".join(data[int(starts[at]) : end].split()).decode()


def _anchor_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(phrase, context, b, words): each at most twice from a batch."""
    for part in parts:
        b = part["b"].to_numpy()
        phrase, context, bucket, doc, place = [], [], [], [], []
        texts: dict[int, tuple[bytes, np.ndarray]] = {}
        for i, h, starts, data in wordhash.batch_at(part["text"].tolist()):
            if len(h) < WINDOW:
                continue
            a = Anchors(h)
            texts[i] = data, starts
            phrase.append(a.phrase)
            context.append(a.context)
            bucket.append(np.full(len(a.at), b[i], np.int32))
            doc.append(np.full(len(a.at), i))
            place.append(a.at)
        if not phrase:
            continue
        p, c, k, d, at = (np.concatenate(x) for x in (phrase, context, bucket, doc, place))
        order = np.lexsort((k, c))
        p, c, k, d, at = p[order], c[order], k[order], d[order], at[order]
        third = np.zeros(len(c), bool)
        third[2:] = (c[2:] == c[:-2]) & (k[2:] == k[:-2])
        keep = ~third
        words = [_spelled(*texts[i], j) for i, j in zip(d[keep].tolist(), at[keep].tolist(), strict=True)]
        yield pd.DataFrame({"phrase": p[keep].view(np.int64), "context": c[keep].view(np.int64), "b": k[keep], "words": words})


def _with_neighbours(parts: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Batches of a sorted stream, for each row whether the row before and the
    row after agree with it on each of columns: arrays (rows, columns)."""
    held: pd.DataFrame | None = None
    before: np.ndarray | None = None  # values of the row before held
    for part in parts:
        if not len(part):
            continue
        rows = part if held is None else pd.concat([held, part], ignore_index=True)
        held = rows.iloc[-1:]
        if len(rows) > 1:
            yield _compared(rows, columns, before, last=False)
            before = rows[columns].iloc[-2].to_numpy()
    if held is not None:
        yield _compared(held, columns, before, last=True)


def _compared(rows: pd.DataFrame, columns: list[str], before: np.ndarray | None, last: bool):
    v = rows[columns].to_numpy()
    same = v[1:] == v[:-1]
    first = np.zeros((1, len(columns)), bool) if before is None else (v[:1] == before)
    prev = np.concatenate([first, same])
    nxt = np.concatenate([same, np.zeros((1, len(columns)), bool)])
    return (rows, prev, nxt) if last else (rows.iloc[:-1], prev[:-1], nxt[:-1])


def _classify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by phrase, context, bucket: the marks of contexts. A whole
    context beside another context of its phrase is a partner in the bucket at
    either end of its run; once is enough."""
    for rows, prev, nxt in _with_neighbours(parts, ["phrase", "context", "b"]):
        same_phrase = prev[:, 0] | nxt[:, 0]
        whole = (prev[:, 0] & prev[:, 1]) | (nxt[:, 0] & nxt[:, 1])
        beside = (prev[:, 0] & ~prev[:, 1]) | (nxt[:, 0] & ~nxt[:, 1])
        mark = np.where(whole, WHOLE | np.where(beside, PARTNER, 0), np.where(same_phrase, DOUBTFUL, 0)).astype(np.int8)
        keep = mark > 0
        if keep.any():
            yield pd.DataFrame({c: rows[k].to_numpy()[keep] for c, k in (("b", "b"), ("phrase", "phrase"), ("value", "context"), ("words", "words"))} | {"mark": mark[keep]})


def _doubtful_windows(docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
    """(window, phrase, b, wanted): hashes of the windows of a bucket's doubtful
    and partner anchors, each at most twice."""
    none = pd.DataFrame({"window": np.zeros(0, np.int64), "phrase": np.zeros(0, np.int64), "b": np.zeros(0, np.int32), "wanted": np.zeros(0, bool)})
    m = marks["mark"].to_numpy()
    asked = np.unique(marks["value"].to_numpy()[(m & (DOUBTFUL | PARTNER)) > 0].view(_U))
    if not len(docs) or not len(asked):
        return none
    doubtful = np.unique(marks["value"].to_numpy()[(m & DOUBTFUL) > 0].view(_U))
    found, phrases, wanted = [], [], []
    for _, h in wordhash.batch(docs["text"].tolist()):
        if len(h) < WINDOW:
            continue
        a = Anchors(h)
        use = _member(a.context, asked)[a.of]
        if use.any():
            found.append(a.windows()[use])
            phrases.append(a.phrase[a.of[use]])
            wanted.append(_member(a.context, doubtful)[a.of[use]])
    if not found:
        return none
    w, p, want = np.concatenate(found), np.concatenate(phrases), np.concatenate(wanted)
    order = np.lexsort((~want, w))
    w, p, want = w[order], p[order], want[order]
    third = np.zeros(len(w), bool)
    third[2:] = w[2:] == w[:-2]
    w, p, want = w[~third], p[~third], want[~third]
    return pd.DataFrame({"window": w.view(np.int64), "phrase": p.view(np.int64), "b": np.full(len(w), docs["b"].iloc[0], np.int32), "wanted": want})


def _found_twice(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows, prev, nxt in _with_neighbours(parts, ["window"]):
        keep = (prev[:, 0] | nxt[:, 0]) & rows["wanted"].to_numpy()
        if keep.any():
            columns = {c: rows[k].to_numpy()[keep] for c, k in (("b", "b"), ("phrase", "phrase"), ("value", "window"))}
            yield pd.DataFrame(columns | {"words": None, "mark": np.full(keep.sum(), WINDOW_MARK, np.int8)})


def _compiled(phrases: set[str]):
    """The automaton of these phrases; None without any."""
    import ahocorasick

    if not phrases:
        return None
    automaton = ahocorasick.Automaton()
    for p in phrases:
        automaton.add_word(f" {p} ", 1)
    automaton.make_automaton()
    return automaton


def _places(automaton, words: list[str]) -> np.ndarray:
    """The word places of every occurrence of the automaton's phrases."""
    ends = np.array([at for at, _ in automaton.iter(f" {' '.join(words)} ")], np.int64)
    if not len(ends):
        return ends
    # after word i (from 0) the space stands at the sum of lengths up to i, plus i + 1
    spaces = np.cumsum(np.fromiter((len(x) + 1 for x in words), np.int64, len(words)))
    return np.searchsorted(spaces, ends) - PHRASE + 1  # ascending, as the ends are


def _regions(places: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The words (from, to) of all windows that hold a phrase at one of these
    ascending places, in a text of n words; regions that meet are one."""
    lo, hi = np.maximum(places - REACH, 0), np.minimum(places + PHRASE + REACH, n)
    cut = np.flatnonzero(lo[1:] > hi[:-1]) + 1
    ends = np.append(cut, len(places)) - 1
    return [(int(lo[i]), int(hi[j])) for i, j in zip(np.append(0, cut), ends, strict=True)]


def _removed(words: list[str], places: np.ndarray, whole: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Which words go: of the windows around the places at which the automaton
    found a phrase, and of no others, those that were confirmed by way of it."""
    gone = np.zeros(len(words), bool)
    regions = [r for r in _regions(places, len(words)) if r[1] - r[0] >= WINDOW]
    for i, h in wordhash.batch([" ".join(words[lo:hi]) for lo, hi in regions]):
        lo, hi = regions[i]
        a = Anchors(h)
        found = _member(a.at + lo, places)  # a found phrase's context lies within the region
        ok = found & _member(a.context, whole)
        start = ok[a.of]
        if len(window):
            maybe = np.flatnonzero((found & ~ok)[a.of])
            if len(maybe):
                start[maybe[_member(a.windows()[maybe], window)]] = True
        start = np.flatnonzero(start)
        step = np.zeros(hi - lo + 1, np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, start + WINDOW, -1)
        gone[lo:hi] |= np.cumsum(step[:-1]) > 0
    return gone


def _cover(docs: pd.DataFrame, marks: pd.DataFrame) -> list[tuple[list[str], np.ndarray]]:
    """(words, which of them go) of a bucket's documents."""
    words = [_WORD.findall(t) for t in docs["text"]]
    value, m = marks["value"].to_numpy().view(_U), marks["mark"].to_numpy()
    whole, window = np.unique(value[(m & WHOLE) > 0]), np.unique(value[(m & WINDOW_MARK) > 0])
    confirmed = set(marks["phrase"].to_numpy()[(m & (WHOLE | WINDOW_MARK)) > 0].tolist())
    spelled = {k: w for k, w in zip(marks["phrase"].tolist(), marks["words"].tolist(), strict=True) if w is not None and k in confirmed}
    automaton = _compiled(set(spelled.values()))
    out = []
    for w in words:
        places = _places(automaton, w) if automaton is not None and len(w) >= WINDOW else np.zeros(0, np.int64)
        out.append((w, _removed(w, places, whole, window) if len(places) else np.zeros(len(w), bool)))
    return out


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with buckets, what was confirmed by bucket)."""
    total = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / BUCKET_CHARS))
    rows = _bucketed(docs, n)
    anchors = rows.select("text", "b").mapInPandas(_anchor_rows, "phrase long, context long, b int, words string")
    sorted_anchors = anchors.repartition("phrase").sortWithinPartitions("phrase", "context", "b")
    marks = stored(sorted_anchors.mapInPandas(_classify, "b int, phrase long, value long, words string, mark byte"))

    asked = marks.where(F.col("mark").bitwiseAND(DOUBTFUL | PARTNER) != 0).drop("words")
    windows = rows.groupBy("b").cogroup(asked.groupBy("b")).applyInPandas(_doubtful_windows, "window long, phrase long, b int, wanted boolean")
    twice = windows.repartition("window").sortWithinPartitions("window").mapInPandas(_found_twice, "b int, phrase long, value long, words string, mark byte")
    # doubtful marks go along: a confirmed window's phrase is spelled in one of its bucket
    return rows, marks.unionByName(stored(twice))


def dedup(docs: DataFrame, separator: str = " ") -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words that stay, joined."""

    def run(group: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        got = _cover(group, marks)
        return pd.DataFrame({
            "doc_id": group["doc_id"], "n_words": [len(w) for w, _ in got], "n_removed": [int(g.sum()) for _, g in got],
            "text": [separator.join([x for x, out in zip(w, g.tolist(), strict=True) if not out]) for w, g in got],
        })

    rows, marks = _prepared(docs)
    return ids_as_long(ids_as_text(rows).groupBy("b").cogroup(marks.groupBy("b")).applyInPandas(run, "doc_id string, n_words long, n_removed long, text string"))


def op9(docs: DataFrame) -> DataFrame:
    def run(group: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        n, removed, digest = [], [], []
        for w, g in _cover(group, marks):
            n.append(len(w))
            removed.append(int(g.sum()))
            kept = [x for x, out in zip(w, g.tolist(), strict=True) if not out] if removed[-1] else w
            digest.append(hashlib.sha256(" ".join(kept).encode()).hexdigest())
        return pd.DataFrame({"doc_id": group["doc_id"], "n_words": n, "n_removed": removed, "kept_sha256": digest})

    rows, marks = _prepared(docs)
    out = ids_as_text(rows).groupBy("b").cogroup(marks.groupBy("b")).applyInPandas(run, "doc_id string, n_words long, n_removed long, kept_sha256 string")
    return ids_as_long(out)
