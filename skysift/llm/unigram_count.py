"""Token counts of a unigram tokenizer, without building the tokens.

An Aho-Corasick automaton over the vocabulary lists every piece that ends at a
character. A Viterbi pass keeps, for each place, the best score and the number
of pieces that lead to it, and nothing else. Ties go as in the tokenizers
library: of equal scores the piece that starts first wins, and a character
without a piece of its own may be unknown at the lowest score less 10. Unknown
characters count as their UTF-8 bytes where the vocabulary has byte pieces, and
as one token a run where not.

The tokenizer is a vocabulary of pieces with scores, read from a SentencePiece
file whose path is a parameter. Spaces become U+2581, one is put in front.
A text is cut before runs of U+2581 if no piece has that mark after another
character, so that words can be counted once a worker; this is exact as long as
sums of scores are exact in binary floating point, as whole numbers are. Where
scores are not whole numbers, texts are counted uncut.

Edge cases: null and empty texts have no tokens. Repeated rows are counted each, null ids stay null.
Extra columns are ignored. Texts of any length are counted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Bound of a worker's store of counted words, and the longest word kept there.
MAX_WORDS, MAX_LENGTH = 500_000, 64

_RUN = re.compile(f"{SPACE}+[^{SPACE}]*")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> tuple[dict[str, float], bool, float]:
    """(pieces with scores, has byte pieces, lowest score)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, has_bytes, low = {}, False, 0.0
    for i in range(model.get_piece_size()):
        if model.is_byte(i):
            has_bytes = True
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[model.id_to_piece(i)] = model.get_score(i)
        low = min(low, model.get_score(i))
    return pieces, has_bytes, low


class Counter:
    """The automaton and a worker's store of counts."""

    def __init__(self, pieces: dict[str, float], has_bytes: bool, low: float | None = None):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.has_bytes = has_bytes
        self.unknown = (min(pieces.values()) if low is None else low) - UNKNOWN_PENALTY
        whole = all(float(s).is_integer() for s in pieces.values())
        self.cuts = whole and has_bytes and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.known: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        """Pieces on the best path over text."""
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        single = [False] * n
        for at, (size, score) in self.automaton.iter(text):
            ends[at].append((size, score))
            if size == 1:
                single[at] = True
        open_run = [False] * (n + 1)  # the best path here ends in an unknown character
        for at in range(n):
            top, pieces, unknown = None, 0, False
            for size, score in sorted(ends[at], reverse=True):  # the earliest start first
                s = score + best[at + 1 - size]
                if top is None or s > top:
                    top, pieces = s, count[at + 1 - size] + 1
            if not single[at]:
                s = self.unknown + best[at]
                if top is None or s > top:
                    more = len(text[at].encode()) if self.has_bytes else 0 if open_run[at] else 1
                    top, pieces, unknown = s, count[at] + more, True
            best[at + 1], count[at + 1], open_run[at + 1] = top, pieces, unknown
        return count[n]

    def word(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = self.viterbi(word)
            if len(word) <= MAX_LENGTH:
                if len(self.known) >= MAX_WORDS:
                    self.known.clear()
                self.known[word] = n
        return n

    def text(self, text: str) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            return self.viterbi(marked)
        known, total = self.known, 0
        for w in _RUN.findall(marked):
            n = known.get(w)
            total += self.word(w) if n is None else n
        return total


_COUNTERS: dict[str, Counter] = {}


def _counter(path: str) -> Counter:
    if path not in _COUNTERS:
        pieces, has_bytes, low = read_vocabulary(path)
        _COUNTERS[path] = Counter(pieces, has_bytes, low)
    return _COUNTERS[path]


def count(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row."""
    path = vocabulary or default_vocabulary()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(path)
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": [counter.text(t) for t in part["text"]]})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_rows(rows, run, "n_tokens long")


def op3(docs: DataFrame) -> DataFrame:
    return count(docs)
