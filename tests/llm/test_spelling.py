"""Spelling variants against comparing every pair of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from skysift.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def corpus(rng):
    """Words with long common beginnings, ends and runs of one letter."""
    stems = ["color", "colour", "aaaaaa", "aaaaaaa", "straße", "çaéà÷", "interest", "x" * 300, "x" * 299 + "y"]
    words = stems + [s[:k] + rng.choice("abé") + s[k:] for s in stems[:7] for k in range(len(s))]
    words += [s[:k] + s[k + 1 :] for s in stems for k in range(0, len(s), max(1, len(s) // 6))]
    words += ["prefix" + "".join(rng.choice("ab") for _ in range(4)) for _ in range(40)] + ["".join(rng.choice("ab") for _ in range(4)) + "suffix" for _ in range(40)]
    rows = [(i, " ".join(rng.choice([w, w.upper(), w]) for w in rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=60))) for i in range(120)]
    return [*rows, (None, "colour colour colour, a null id"), (500, None), (501, ""), (502, "1 2 3 \n"), rows[0], rows[0], (503, "Ünder Ünder ünder Ÿbcde")]


@pytest.mark.parametrize("cell", [spelling.CELL, 8])
def test_variants_equal_all_pairs(spark, cell, monkeypatch):
    rows = corpus(random.Random(cell))
    monkeypatch.setattr(spelling.near_words, "__defaults__", (cell,))
    df = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, n int, key string, m int").repartition(3)
    got = [tuple(r) for r in spelling.op11(df).collect()]
    want = plain(rows)
    assert len(got) == len(want) and set(got) == want
    assert sum(g[1] is not None for g in got) > 20 and any(g[1] not in (None, g[2]) for g in got)
    assert spelling.op11(df.where("doc_id = -1")).count() == 0


def test_large_keys_are_split(spark):
    """With a small bound no key of over one place has more words than that, and
    cells of one place hold a letter's choice at most."""
    words = [("common" + f"{a}{b}{c}" + "ending", 3) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    rows = spelling.cells(spark.createDataFrame(words, "word string, n long"), cell=20)
    sizes = rows.groupBy("key", "lo", "hi").count().collect()
    assert max(r["count"] for r in sizes) <= 20
    assert max(r["count"] for r in spelling.cells(spark.createDataFrame(words, "word string, n long"), cell=600).groupBy("key").count().collect()) > 20


def test_blocks_find_every_pair():
    """One key that spans many blocks, against all pairs."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice((6, 7)))) for _ in range(500)})
    raw = [w.encode("latin-1") for w in words]
    k = np.ones(len(words), np.int64)
    a, b = spelling.near_pairs(raw, 7, 0 * k, 6 * k, k)
    want = {(i, j) for i in range(len(words)) for j in range(i) if max(len(words[i]), len(words[j])) == 7 and one_edit(words[i], words[j])}
    assert {(max(x), min(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} == want and len(a) == len(want)
