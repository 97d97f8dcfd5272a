"""Hashes of words and word windows over many texts at once, in NumPy.

Words are runs without U+0020 and U+0009 to U+000D. A word's hash is a
polynomial over its bytes with random coefficients, mixed to 64 bits; a
window's hash is a mixed polynomial over its words' hashes. Both depend on the
content alone, so every task and machine finds the same values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

#: Texts are hashed in slices of about so many bytes, which bounds memory.
SLICE = 1 << 20

_BYTES = np.array([int.from_bytes(hashlib.md5(b"byte" + bytes([i])).digest()[:8], "little") for i in range(256)], np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 256), _BASE, np.uint64)
        more[0] = 1
        _powers = np.cumprod(more)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (new array)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _slices(data: bytes) -> Iterator[bytes]:
    """Parts of data that end at white space."""
    at, n = 0, len(data)
    while n - at > SLICE:
        end = at + SLICE
        b = np.frombuffer(data, np.uint8, count=SLICE, offset=at)
        white = np.flatnonzero(_WHITE[b])
        if len(white):
            end = at + int(white[-1]) + 1
        else:  # a word of over a slice: to its end
            while end < n and not _WHITE[data[end]]:
                end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def words(data: bytes, lower: bool = False) -> np.ndarray:
    """Hashes of the words of UTF-8 data, in order."""
    return np.concatenate([_words(s, lower)[0] for s in _slices(data)])


def _words(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(data, np.uint8)
    if lower:
        b = _LOWER[b]
    n = len(b)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    white = _WHITE[b]
    first = ~white
    first[1:] &= white[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    place = np.arange(n, dtype=np.int32)
    place -= np.maximum.accumulate(np.where(first, place, np.int32(0)))
    v = _BYTES[b]
    v *= powers(int(place.max()) + 1)[place]
    v[white] = 0
    return mix(np.add.reduceat(v, starts)), starts


def batch(texts: list[str], lower: bool = False) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, its word hashes), texts hashed many at a time."""
    for i, h, _, _ in batch_at(texts, lower):
        yield i, h


def batch_at(texts: list[str], lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    """(index of the text, its word hashes, the bytes at which its words begin,
    its UTF-8)."""
    group: list[bytes] = []
    first, size = 0, 0
    for i, t in enumerate(texts):
        data = t.encode()
        if size + len(data) > SLICE and group:
            yield from _group(first, group, lower)
            group, size = [], 0
        if not group:
            first = i
        group.append(data)
        size += len(data) + 1
    if group:
        yield from _group(first, group, lower)


def _group(first: int, group: list[bytes], lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    if len(group) == 1:
        parts, at = [], 0
        for s in _slices(group[0]):
            h, starts = _words(s, lower)
            parts.append((h, starts + at))
            at += len(s)
        yield first, np.concatenate([h for h, _ in parts]), np.concatenate([x for _, x in parts]), group[0]
        return
    h, starts = _words(b"\n".join(group), lower)
    edges = np.cumsum([0] + [len(g) + 1 for g in group])
    at = np.searchsorted(starts, edges)
    for i in range(len(group)):
        yield first + i, h[at[i] : at[i + 1]], starts[at[i] : at[i + 1]] - edges[i], group[i]


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # sums of 2, 4, 8 ... words by doubling, put together to k
    total, done = None, 0
    part, size = h, 1
    while True:
        if k & size:
            piece = part[done : done + n]
            total = piece * np.uint64(pow(_BASE, k - done - size, 1 << 64)) if total is None else total + piece * np.uint64(pow(_BASE, k - done - size, 1 << 64))
            done += size
        if size * 2 > k:
            break
        part = part[: len(part) - size] * np.uint64(pow(_BASE, size, 1 << 64)) + part[size:]
        size *= 2
    return mix(total)
