"""Document quality from a linear-chain conditional random field over lines.

Every line is good (1) or bad (0). A line's potentials come from its own
features and those of its neighbours; a two-by-two table joins neighbouring
labels. Forward-backward gives each line's marginal, and a document's quality
is the mean of its marginals weighted by line length, put through a fitted
logistic curve.

Training reads a bounded sample of labelled documents. Lines start with their
document's label; then, twice, lines of bad documents that the model itself
holds good are relabelled and the field is fitted again.

Edge cases: null, empty and blank texts have no line and score by the curve's
value at quality 0.5. Repeated rows get the same score, null ids stay null. Extra columns are
ignored; ``lang``, ``source`` and the id never enter a score. Without usable
labels every score is 0.5.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .toxicity import fit_linear, held_out, labelled_sample

#: Bound of the labelled sample, by class.
MAX_PER_CLASS = 1200
PADDED = 40_000
THRESHOLD = 0.5

_SYMBOL = re.compile(r"[#*$%&|<>]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_OTHER = re.compile(r"[^\w\s]|_")
N_OWN = 13


def _line(line: str, seen: bool) -> tuple[float, ...]:
    words = line.split()
    n, size = len(words), len(line)
    distinct = len(set(words)) / n
    symbols = len(_SYMBOL.findall(line)) / n
    upper = len(_UPPER.findall(line)) / size
    mean = size / n
    return (
        min(symbols, 1.0), float(symbols > 0.2), upper, float(upper > 0.4), 1 - distinct, float(n >= 8 and distinct < 0.5),
        min(10 * len(_DIGIT.findall(line)) / size, 1.0), min(3 * len(_OTHER.findall(line)) / size, 1.0), min(mean / 20, 1.0),
        min(n, 20) / 20, float(line[-1:] in ".!?:;"), float(seen), min(line.count("!!") * 4 / n, 1.0),
    )


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(T x F features with the neighbours' and a constant, T weights)."""
    own, size, seen = [], [], set()
    for line in text.split("\n"):
        if line and not line.isspace():
            own.append(_line(line, line in seen))
            size.append(len(line))
            seen.add(line)
    if not own:
        return np.zeros((0, 3 * N_OWN + 3)), np.zeros(0)
    x = np.asarray(own)
    out = np.zeros((len(x), 3 * N_OWN + 3))
    out[:, :N_OWN] = x
    out[1:, N_OWN : 2 * N_OWN] = x[:-1]
    out[:-1, 2 * N_OWN : 3 * N_OWN] = x[1:]
    out[:, -3] = 1
    out[0, -2] = 1
    out[-1, -1] = 1
    return out, np.asarray(size, dtype=float)


def marginals(node: list[np.ndarray], trans: np.ndarray, pairs: bool = False):
    """Forward-backward over many chains at once. node: each chain's log-odds
    of good by line; trans: 2 x 2 log potentials. Returns each chain's marginals
    of good, and with pairs the summed expected transition counts as well."""
    order = sorted((i for i, c in enumerate(node) if len(c)), key=lambda i: -len(node[i]))
    out = [np.zeros(len(c)) for c in node]
    expected = np.zeros((2, 2))
    if not order:
        return (out, expected) if pairs else out
    lengths = np.array([len(node[i]) for i in order])
    top = lengths[0]
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(top)]  # chains longer than t
    phi = np.zeros((top, len(order), 2))
    for j, i in enumerate(order):
        phi[: lengths[j], j, 1] = node[i]
    np.clip(phi, -30, 30, out=phi)
    phi = np.exp(phi - phi.max(axis=2, keepdims=True))
    a = np.exp(trans)
    fwd = np.zeros_like(phi)
    fwd[0] = phi[0] / phi[0].sum(axis=1, keepdims=True)
    for t in range(1, top):
        m = active[t]
        f = (fwd[t - 1, :m] @ a) * phi[t, :m]
        fwd[t, :m] = f / f.sum(axis=1, keepdims=True)
    bwd = np.ones_like(phi)
    for t in range(top - 2, -1, -1):
        m = active[t + 1]
        b = (phi[t + 1, :m] * bwd[t + 1, :m]) @ a.T
        bwd[t, :m] = b / b.sum(axis=1, keepdims=True)
    both = fwd * bwd
    both /= np.maximum(both.sum(axis=2, keepdims=True), 1e-300)
    if pairs:
        for t in range(top - 1):
            m = active[t + 1]
            e = fwd[t, :m, :, None] * a * (phi[t + 1, :m] * bwd[t + 1, :m])[:, None, :]
            expected += (e / e.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    for j, i in enumerate(order):
        out[i] = both[: lengths[j], j, 1].copy()
    return (out, expected) if pairs else out


def fit(chains: list[np.ndarray], y: list[np.ndarray], rounds: int = 80, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Node weights and transitions by gradient ascent on the likelihood."""
    x, labels = np.vstack(chains), np.concatenate(y).astype(float)
    cuts = np.cumsum([len(c) for c in chains])[:-1]
    seen = np.zeros((2, 2))
    for v in y:
        np.add.at(seen, (v[:-1].astype(int), v[1:].astype(int)), 1)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, s = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for t in range(1, rounds + 1):
        got, pairs = marginals(np.split(x @ w, cuts), trans, pairs=True)
        g = np.concatenate([x.T @ (labels - np.concatenate(got)), (seen - pairs).ravel()]) / len(x) - l2 * np.concatenate([w, trans.ravel()])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        w, trans = w + step[:-4], trans + step[-4:].reshape(2, 2)
    return w, trans


def quality(chains: list[np.ndarray], sizes: list[np.ndarray], w: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of each document; 0.5 without lines.
    Chains of like length go together, at most PADDED lines with padding (or
    one chain), so that long texts need no more memory than their lines."""
    got = [np.zeros(0)] * len(chains)
    order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
    group: list[int] = []
    for at, i in enumerate(order):
        group.append(i)
        more = len(chains[order[at + 1]]) if at + 1 < len(order) else None
        if more is None or more * (len(group) + 1) > PADDED:
            for k, g in zip(group, marginals([chains[k] @ w for k in group], trans), strict=True):
                got[k] = g
            group = []
    return np.array([float(g @ z / z.sum()) if len(g) else 0.5 for g, z in zip(got, sizes, strict=True)])


def _curve(q: np.ndarray) -> np.ndarray:
    return 4 * q[:, None] - 2


def score(docs: DataFrame, labels: DataFrame, is_held_out: Column | None = None) -> DataFrame:
    """(doc_id, score) of every row of docs."""
    out = held_out(mod=3, rest=1) if is_held_out is None else is_held_out
    known = F.broadcast(labelled_sample(labels, "quality", out, MAX_PER_CLASS).coalesce(1))
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the lines' features, not the texts, are what the bounded sample brings in
    sample = text.join(known, "doc_id").select(F.xxhash64("doc_id").alias("h"), "text", "y", "weight")
    got = sample.mapInPandas(_compact, "h long, y int, weight double, x binary, size binary").toPandas().sort_values(["h", "y", "x"])
    w, trans, curve = _train_compact(got)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 256):
                some = part.iloc[at : at + 256]
                both = [features(t) for t in some["text"]]
                q = quality([x for x, _ in both], [z for _, z in both], w, trans)
                z = np.hstack([_curve(q), np.ones((len(q), 1))]) @ curve
                yield pd.DataFrame({"doc_id": some["doc_id"], "quality_marginal": q, "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    return map_rows(text, run, "quality_marginal double, score double")


def _compact(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = [features(t) for t in part["text"]]
        yield pd.DataFrame({
            "h": part["h"], "y": part["y"], "weight": part["weight"],
            "x": [x.astype(np.float16).tobytes() for x, _ in rows],
            "size": [z.astype(np.float32).tobytes() for _, z in rows],
        })


def _train_compact(got: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = 3 * N_OWN + 3
    rows = [
        (np.frombuffer(x, np.float16).reshape(-1, width).astype(float), np.frombuffer(z, np.float32).astype(float), int(y), t)
        for x, z, y, t in zip(got["x"], got["size"], got["y"], got["weight"], strict=True)
    ]
    rows = [r for r in rows if len(r[0])]
    return train(rows)


def train(rows: list[tuple[np.ndarray, np.ndarray, int, float]], rounds: int = 2):
    """(node weights, transitions, curve) from (features, weights, label, rows of
    the table that this one stands for); the curve follows the table's shares."""
    if len({r[2] for r in rows}) < 2:
        return np.zeros(3 * N_OWN + 3), np.zeros((2, 2)), np.zeros(2)
    chains, sizes, truth, stands = ([r[i] for r in rows] for i in range(4))
    y = [np.full(len(x), t) for x, _, t, _ in rows]
    w, trans = fit(chains, y)
    for _ in range(rounds):
        got = marginals([c @ w for c in chains], trans)
        for i, t in enumerate(truth):
            if t == 0:
                good = got[i] > 0.5
                if not good.all():  # a bad document keeps a bad line at least
                    y[i] = good.astype(int)
        w, trans = fit(chains, y)
    q = quality(chains, sizes, w, trans)
    return w, trans, fit_linear(_curve(q), np.asarray(truth, float), rounds=600, l2=1e-4, weight=np.asarray(stands, float))


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = score(docs, labels)
    return rows.select(
        "doc_id", held_out(mod=3, rest=1).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "quality_marginal",
    )
