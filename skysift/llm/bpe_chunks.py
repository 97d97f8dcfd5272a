"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over a text's bytes sets chunk ends by content alone, so a
passage that several documents share falls into the same chunks wherever it
stands. Each worker encodes a chunk once and keeps it in a bounded store: the
words inside it are put together from a bounded store of words, and only words
that are new go to the tokenizer. The words that a chunk's ends may have cut are
kept as they are. Where two chunks meet, the join is repaired: the cut word is
encoded anew between the whole words on either side, and its ids are what lies
between theirs if those come out as they were before. If they do not, the window
grows to the whole text, which agrees with itself.

White space (ASCII) never lies inside a pre-token, and normalising does not
reach over it, so for the tokenizers that are accepted here windows agree at
once; the tests hold this against the tokenizer on whole texts.

Edge cases: null and empty texts have no ids and decode to the empty text.
Repeated rows are encoded each, null ids stay null. Extra columns are ignored. Texts of any length
are encoded whole; a run without white space is one word, whatever its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: A chunk has 2**CHUNK_BITS bytes on average. Texts of a batch have about
#: BATCH_BYTES; longer words than MAX_WORD are not kept.
CHUNK_BITS, BATCH_BYTES, MAX_WORD = 11, 1 << 21, 256
#: Bounds of a worker's stores: words, and bytes of chunks with their tokens.
MAX_WORDS, MAX_CHUNK_BYTES = 700_000, 48 << 20

#: A word of Latin letters with ASCII marks before and after: the pre-tokenizer
#: parts it there, and letter case goes, so parts recur far more than words. The
#: letters are composed ones; marks cannot start a contraction at the end.
_PARTED = re.compile(rb"([!-/:-@\[-`{-~]*)([A-Za-z]+)([!-/:-@\[-`{-~]*)")
_PARTED_LATIN = re.compile(r"([!-/:-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")

_TABLE = np.array([int.from_bytes(hashlib.md5(bytes([i])).digest()[:4], "little") for i in range(256)], np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def chunk_ends(data: bytes) -> list[int]:
    """Chunk ends of a text's bytes: where the hash of the 16 bytes before says
    so, moved to the next character's start."""
    n = len(data)
    if n <= 1 << CHUNK_BITS:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    h = _TABLE[b]
    for k in (1, 2, 4, 8):  # by doubling
        h[k:] += h[:-k].copy() * np.uint32(pow(0x9E3779B1, k, 1 << 32))
    ends, last = [], 0
    for e in (np.flatnonzero((h >> np.uint32(32 - CHUNK_BITS)) == 0) + 1).tolist():
        while e < n and (data[e] & 0xC0) == 0x80:
            e += 1
        if last < e < n:
            ends.append(e)
            last = e
    return [*ends, n]


class Chunk(NamedTuple):
    """A chunk's words: those its ends may have cut (head, tail; both the chunk
    itself if it has no white space), ids and tokens of the words between, and
    the first and last of these with their ids."""

    whole: bool
    head: bytes
    tail: bytes
    ids: bytes
    tokens: bytes
    first: tuple[bytes, bytes] | None
    last: tuple[bytes, bytes] | None


class Encoder:
    """A worker's stores. Ids and tokens are kept as bytes, each joined by
    spaces."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.token[i] = t.encode()
        self.number = [str(i).encode() for i in range(len(self.token))]
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        if ids("one  two\n") != ids("one") + ids("two"):
            raise ValueError("chunks need a tokenizer that drops white space")
        #: Whether the tokenizer parts words as _PARTED does.
        self.parted = ids('"One!?') == ids('"') + ids("one") + ids("!?")
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.parts: dict[bytes, tuple[bytes, bytes]] = {b"": (b"", b"")}
        #: Whether some word has no ids.
        self.empty = False
        self.chunks: dict[bytes, Chunk] = {}
        self.joins: dict[tuple, tuple[bytes, bytes] | None] = {}
        self.chunk_bytes = 0

    def learn(self, words: set[bytes], parted: bool) -> None:
        """Encodes the words that are not in the store yet, by their parts if
        they may be parted. A full store is emptied before, never after."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > MAX_WORDS:
            self.words.clear()
            new = list(words)
        split: list[tuple[bytes, bytes, bytes, bytes]] = []
        need: set[bytes] = set()
        for w in new:
            m = _PARTED.fullmatch(w) if parted else None
            if m:
                before, letters, after = m.groups()
                letters = letters.lower()
            elif m := _PARTED_LATIN.fullmatch(w.decode()) if parted else None:
                before, letters, after = m[1].encode(), m[2].lower().encode(), m[3].encode()
            if not m or before[-1:] == b"'":  # 's and the like are one pre-token
                before, letters, after = b"", w, b""
            split.append((w, before, letters, after))
            need.add(letters)
            if before:
                need.add(before)
            if after:
                need.add(after)
        known = self.parts
        if len(known) + len(need) > MAX_WORDS:
            known.clear()
            known[b""] = (b"", b"")
        missing = [p for p in need if p not in known]
        number, token = self.number, self.token
        for p, ids in zip(missing, self.raw([p.decode() for p in missing]), strict=True):
            known[p] = (b" ".join([number[i] for i in ids]), b" ".join([token[i] for i in ids]))
        words = self.words
        for w, before, letters, after in split:
            got = known[letters]
            if before:
                x = known[before]
                got = (x[0] + b" " + got[0], x[1] + b" " + got[1])
            if after:
                x = known[after]
                got = (got[0] + b" " + x[0], got[1] + b" " + x[1])
            words[w] = got
            self.empty |= not got[0]

    def raw(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for at in range(0, len(texts), 8192):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 8192], add_special_tokens=False)]
        return out

    def chunk(self, data: bytes, words: list[bytes]) -> Chunk:
        """A new chunk of these words, stored; its inner words are known."""
        opened, ended = not _SPACE[data[0]], not _SPACE[data[-1]]
        if opened and ended and len(words) == 1:
            got = Chunk(True, data, data, b"", b"", None, None)
        else:
            inner = words[opened : len(words) - ended]
            parts = list(map(self.words.__getitem__, inner))
            if self.empty:
                parts = [p for p in parts if p[0]]
            got = Chunk(
                False, words[0] if opened else b"", words[-1] if ended else b"", b" ".join([p[0] for p in parts]), b" ".join([p[1] for p in parts]),
                (inner[0], self.words[inner[0]][0]) if inner else None, (inner[-1], self.words[inner[-1]][0]) if inner else None,
            )
        self.chunk_bytes += len(data) + len(got.ids) + len(got.tokens) + 500
        if self.chunk_bytes > MAX_CHUNK_BYTES:
            self.chunks.clear()
            self.chunk_bytes = len(data)
        self.chunks[data] = got
        return got

    def walk(self, chunks: list[Chunk]) -> list:
        """A text's parts in order: inner (ids, tokens) of its chunks and, where
        chunks meet, (left, cut word, right) with the whole words beside it."""
        out, carry, left = [], [], None
        for c in chunks:
            if c.whole:
                carry.append(c.head)
                continue
            word = b"".join(carry) + c.head
            if word:
                out.append((left, word, c.first))
                left = None
            if c.ids:
                out.append((c.ids, c.tokens))
            left = c.last or left
            carry = [c.tail] if c.tail else []
        if carry:
            out.append((left, b"".join(carry), None))
        return out

    def repaired(self, joins: set) -> dict:
        """(left, cut word, right) -> (ids, tokens), or None if the whole words
        do not come out as they were."""
        known, number, token = self.joins, self.number, self.token
        new = [j for j in joins if j not in known]
        if len(known) + len(new) > MAX_WORDS // 4:
            known.clear()
            new = list(joins)
        got: dict = {}
        for (left, word, right), ids in zip(new, self.raw([b" ".join([x for x in (a and a[0], w, b and b[0]) if x]).decode() for a, w, b in new]), strict=True):
            before, after = left[1].split() if left else [], right[1].split() if right else []
            text = [number[i] for i in ids]
            n = len(text) - len(after)
            agree = n >= len(before) and text[: len(before)] == before and text[n:] == after
            part = (b" ".join(text[len(before) : n]), b" ".join([token[i] for i in ids[len(before) : n]])) if agree else None
            got[left, word, right] = part
            if len(word) <= MAX_WORD:
                known[left, word, right] = part
        return {j: got[j] if j in got else known[j] for j in joins}

    def batch(self, texts: list[str]) -> Iterator[tuple[list[bytes], list[bytes]]]:
        """For every text, the ids and the tokens of its parts."""
        some: list[bytes] = []
        size = 0
        for t in texts:
            some.append(t.encode())
            size += len(some[-1])
            if size > BATCH_BYTES:
                yield from self._some(some)
                some, size = [], 0
        if some:
            yield from self._some(some)

    def _some(self, some: list[bytes]) -> Iterator[tuple[list[bytes], list[bytes]]]:
        parted = self.parted and not any(s in t for t in some for s in self.special)
        pieces = [[t[a:b] for a, b in zip([0, *ends], ends)] for t, ends in ((t, chunk_ends(t)) for t in some)]  # noqa: B905
        held = {p: self.chunks.get(p) for own in pieces for p in own}  # what is in use outlives the store
        new = {p: p.split() for p, c in held.items() if c is None}
        need: set[bytes] = set()
        for words in new.values():
            need.update(words)
        self.learn(need, parted)
        held.update({p: self.chunk(p, words) if words else Chunk(False, b"", b"", b"", b"", None, None) for p, words in new.items()})
        walks = [self.walk([held[p] for p in own]) for own in pieces]
        fixed = self.repaired({x for w in walks for x in w if len(x) == 3})
        for t, w in zip(some, walks, strict=True):
            both = [fixed[x] if len(x) == 3 else x for x in w]
            if None in both:  # no agreement: the window is the whole text
                ids = self.raw([t.decode()])[0]
                both = [(b" ".join([self.number[i] for i in ids]), b" ".join([self.token[i] for i in ids]))]
            both = [x for x in both if x[0]]
            yield [x[0] for x in both], [x[1] for x in both]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row."""
    path = tokenizer or default_tokenizer()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for part in parts:
            both = list(encoder.batch(part["text"].tolist()))
            ids = [np.array(b" ".join(i).split(), dtype=np.int32) for i, _ in both]
            yield pd.DataFrame({"doc_id": part["doc_id"], "ids": ids, "decoded": [b" ".join(d).decode() for _, d in both]})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(rows, run, "ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode's results as
    digests, taken chunk by chunk in the same pass."""
    path = tokenizer or default_tokenizer()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for part in parts:
            n, ids_hash, text_hash = [], [], []
            for ids, tokens in encoder.batch(part["text"].tolist()):
                all_ids = b" ".join(ids)
                n.append(all_ids.count(b" ") + 1 if all_ids else 0)
                ids_hash.append(hashlib.sha256(all_ids).hexdigest())
                text_hash.append(hashlib.sha256(b" ".join(tokens)).hexdigest())
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": text_hash})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(rows, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5(docs: DataFrame) -> DataFrame:
    return digests(docs)
