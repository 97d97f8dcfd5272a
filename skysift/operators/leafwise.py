"""Histogram boosting whose trees grow leaf by leaf, the leaf that gains most first.

As scikit-learn's HistGradientBoostingClassifier grows them: up to 255 bins of a
column by its percentiles, softmax trees (one a round for two classes) of at most
31 leaves of 20 rows or more and no bound on their depth, rate 0.1. Over 10,000
training rows a tenth of them, even by class, is held out of the trees, and the
rounds end when its loss has not fallen for ten rounds.

A model is fitted in one task, on all rows that are not its fold's: which leaf is
next follows from all sums so far, and a pass over the cluster for each of 30
splits a round would cost far more than the sums. A task holds about 800 bytes a
row (8 columns, 10 classes, by count of its arrays). Everything is learned from training rows alone:
medians for missing values, bins, trees. The best split of a leaf of every class
is sought at once; of two children the smaller is summed, the other is the rest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS, LEAVES, LEAST, RATE = 255, 31, 20, 0.1
#: Training rows from which on rounds may end early, rounds that the loss may
#: fail to fall, and what counts as a fall.
MANY, WAIT, FALL = 10_000, 10, 1e-7
LEAST_HESSIAN, LEAST_GAIN, TINY = 1e-3, 1e-9, 1e-15
#: Rows (of a class) that are summed at once.
HELD = 1 << 17


def medians(x: np.ndarray) -> np.ndarray:
    """Of the finite values of each column; 0 where there is none."""
    finite = [c[np.isfinite(c)] for c in x.T]
    return np.array([np.median(c) if len(c) else 0.0 for c in finite])


def filled(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, values)


def thresholds(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Upper ends of all bins but the last: between the values if these are few,
    else percentiles."""
    distinct = np.unique(x)
    if len(distinct) <= bins:
        return distinct[:-1] / 2 + distinct[1:] / 2
    return np.unique(np.percentile(x, np.linspace(0, 100, bins + 1)[1:-1], method="midpoint"))


def chances(raw: np.ndarray) -> np.ndarray:
    """(rows, classes) of the grown classes: softmax, or for one the logistic."""
    if raw.shape[1] == 1:
        return 1 / (1 + np.exp(-raw))
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss(raw: np.ndarray, y: np.ndarray) -> float:
    """Mean of minus the logarithm of the true class's probability."""
    if raw.shape[1] == 1:
        return float(np.logaddexp(0, np.where(y == 1, -raw[:, 0], raw[:, 0])).mean())
    top = raw.max(axis=1)
    return float((np.log(np.exp(raw - top[:, None]).sum(axis=1)) + top - raw[np.arange(len(y)), y]).mean())


def sums(cells: np.ndarray, at: list[np.ndarray], tree: list[int], g: np.ndarray, h: np.ndarray, features: int, bins: int) -> np.ndarray:
    """(len(at), 3, feature, bin): gradients, hessians and rows of the rows at[i]
    in tree tree[i]; cells hold feature * bins + bin."""
    width = features * bins
    out = np.zeros((len(at), 3, width))
    lo = 0
    while lo < len(at):  # so many at once as HELD allows, a large one in pieces
        hi, n = lo + 1, len(at[lo])
        while hi < len(at) and n + len(at[hi]) <= HELD:
            n += len(at[hi])
            hi += 1
        rows = np.concatenate(at[lo:hi])
        own = np.repeat(np.arange(hi - lo), [len(a) for a in at[lo:hi]])
        of = np.repeat(np.asarray(tree[lo:hi]), [len(a) for a in at[lo:hi]])
        for i in range(0, len(rows), HELD):
            r, o, t = rows[i : i + HELD], own[i : i + HELD], of[i : i + HELD]
            place = (cells[r] + (o * width)[:, None]).ravel()
            for k, w in enumerate((g[t, r], h[t, r], None)):
                out[lo:hi, k] += np.bincount(place, None if w is None else np.repeat(w, features), (hi - lo) * width).reshape(-1, width)
        lo = hi
    return out.reshape(len(at), 3, features, bins)


def best_splits(s: np.ndarray, least: int, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, place, sums of the left side) of the leaves of sums s; place is
    feature * bins + highest bin of the left side, the first of equals. The last
    bin leaves no row on the right, and least is 1 or more."""
    left = s.cumsum(axis=3)
    total = left[:, :, :1, -1:]
    right = total - left
    gl, hl, nl = left[:, 0], left[:, 1], left[:, 2]
    gr, hr, nr = right[:, 0], right[:, 1], right[:, 2]
    ok = (np.minimum(nl, nr) >= least) & (np.minimum(hl, hr) >= LEAST_HESSIAN)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gl * gl / (hl + (l2 + TINY)) + gr * gr / (hr + (l2 + TINY)) - total[:, 0] ** 2 / (total[:, 1] + (l2 + TINY))
    gain = np.where(ok, np.round(gain, 9), -1.0).reshape(len(s), -1)
    place, each = gain.argmax(axis=1), np.arange(len(s))
    f, cut = np.divmod(place, s.shape[3])
    return gain[each, place], place, left[each, :, f, cut]


@dataclass
class Tree:
    """Of every node the feature (-1: leaf), the highest bin of the left side, the
    left child (the right one is next to it) and the value."""

    feature: list[int]
    cut: list[int]
    left: list[int]
    value: list[float]

    def leaf(self, value: float) -> int:
        self.feature.append(-1)
        self.cut.append(0)
        self.left.append(0)
        self.value.append(value)
        return len(self.value) - 1

    def place(self, b: np.ndarray) -> np.ndarray:
        """The leaf of every row of bins b."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        node, row = np.zeros(len(b), np.int64), np.arange(len(b))
        while (feature[node] >= 0).any():
            f = feature[node]
            node = np.where(f >= 0, left[node] + (b[row, f] > cut[node]), node)
        return node


def grow(b: np.ndarray, cells: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int, leaves: int = LEAVES, least: int = LEAST, l2: float = 0.0, rate: float = RATE) -> tuple[list[Tree], np.ndarray]:
    """A tree for every row of g and h (trees, rows), and the values that they give
    to the rows. b: bins of the rows, cells: feature * bins + bin."""
    n, features = b.shape
    value = lambda s: float(-rate * s[0] / (s[1] + l2 + TINY))
    trees, step = [Tree([], [], [], []) for _ in g], np.empty((len(g), n))
    heaps: list[list] = [[] for _ in g]
    rows: list[dict[int, np.ndarray]] = [{} for _ in g]

    def opened(s: np.ndarray, t: int, nodes: list[int]) -> None:
        for gain, place, side, own, node in zip(*best_splits(s, least, l2), s, nodes, strict=True):
            if gain > LEAST_GAIN:
                heapq.heappush(heaps[t], (-gain, node, int(place), side, own))

    every = np.arange(n)
    for t, (tree, own) in enumerate(zip(trees, rows, strict=True)):
        own[tree.leaf(value((g[t].sum(), h[t].sum())))] = every
    for t in range(len(g)):
        opened(sums(cells, [every], [t], g, h, features, bins), t, [0])
    for turn in range(leaves - 1):
        small, rest, of = [], [], []
        for t, heap in enumerate(heaps):
            if not heap:
                continue
            _, node, place, side, own = heapq.heappop(heap)
            f, cut = divmod(place, bins)
            at = rows[t].pop(node)
            down = b[at, f] <= cut
            total = own[:, 0].sum(axis=1)
            tree = trees[t]
            tree.feature[node], tree.cut[node] = f, cut
            tree.left[node] = tree.leaf(value(side))
            right = tree.leaf(value(total - side))
            rows[t][right - 1], rows[t][right] = at[down], at[~down]
            less, more = sorted((right - 1, right), key=lambda x: len(rows[t][x]))
            if len(rows[t][more]) >= 2 * least:
                small.append(rows[t][less])
                rest.append((own, less, more))
                of.append(t)
        if not any(heaps) and not of:
            break
        if turn < leaves - 2:  # the last children are not split
            each = sums(cells, small, of, g, h, features, bins)
            for t, s, (own, less, more) in zip(of, each, rest, strict=True):  # two leaves' sums fit the cache
                both = len(rows[t][less]) >= 2 * least
                opened(np.stack([s, own - s][1 - both :]), t, [less, more][1 - both :])
    for t, (tree, own) in enumerate(zip(trees, rows, strict=True)):
        for node, at in own.items():
            step[t, at] = tree.value[node]
    return trees, step


def halt(scores: list[float]) -> bool:
    """Whether none of the last WAIT losses is below the one before them."""
    return len(scores) > WAIT and not any(x < scores[-WAIT - 1] - FALL for x in scores[-WAIT:])


def fit_predict(x: np.ndarray, y: np.ndarray, train: np.ndarray, tenth: np.ndarray, classes: int, rounds: int, **how) -> tuple[np.ndarray, int]:
    """(classes of the rows that are not of train, rounds): by a model of the rows
    of train. tenth marks the rows that are held out where rounds may end early."""
    early = int(train.sum()) > MANY
    own = train & ~tenth if early else train
    x = filled(x, medians(x[train]))
    ends = [thresholds(c[own]) for c in x.T]
    bins = BINS + 1
    b = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(ends, x.T, strict=True)], axis=1).astype(np.uint8)
    fit, check, test = (b[m] for m in (own, train & ~own, ~train))
    cells = (fit + np.arange(b.shape[1]) * bins).astype(np.uint16 if b.shape[1] * bins < 1 << 16 else np.int32)
    y_fit, y_check = y[own], y[train & ~own]
    share = np.clip(np.bincount(y_fit, minlength=classes) / max(len(y_fit), 1), np.finfo(float).eps, 1 - np.finfo(float).eps)
    base = np.log(share[1:] / share[:1]) if classes == 2 else np.log(share)
    raws = [np.tile(base, (len(m), 1)) for m in (fit, check, test)]
    hit = (y_fit[:, None] == (np.arange(classes) if classes != 2 else np.array([1]))).astype(float)
    losses, done = [loss(raws[1], y_check)] if len(check) else [], 0
    for _ in range(rounds if len(fit) else 0):
        p = chances(raws[0])
        trees, step = grow(fit, cells, np.ascontiguousarray((p - hit).T), np.ascontiguousarray((p * (1 - p)).T), bins, **how)
        raws[0] += step.T
        for m, raw in zip((check, test), raws[1:], strict=True):
            for t, tree in enumerate(trees if len(m) else []):
                raw[:, t] += np.array(tree.value)[tree.place(m)]
        done += 1
        if len(check):
            losses.append(loss(raws[1], y_check))
            if halt(losses):
                break
    return ((raws[2][:, 0] > 0).astype(int) if classes == 2 else raws[2].argmax(axis=1)), done


def out_of_fold(
    df: DataFrame, label: str, fold: str, tenth: str, columns: tuple[str, ...], classes: int, folds: list[int], rounds: int, keep: tuple[str, ...], order: tuple[str, ...]
) -> DataFrame:
    """keep, label and prediction of every row, by the model that is fitted on the
    other folds: a task for each of folds. Rows are taken in the order given, so
    that sums do not depend on how they arrive."""
    x = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]
    rows = df.select(*keep, F.col(label).cast("int").alias(label), F.col(fold).cast("int").alias("_fold"), F.col(tenth).cast("boolean").alias("_tenth"), *x)
    schema = rows.select(*keep, label).schema.add("prediction", T.IntegerType())
    names, needed = schema.names[:-1], (label, "_fold", "_tenth", *[f"_x{i}" for i in range(len(columns))])
    each = rows.withColumn("_model", F.explode(F.array(*[F.lit(k) for k in range(len(folds))]).cast("array<int>")))
    dealt = each.repartitionById(max(len(folds), 1), F.col("_model")).sortWithinPartitions("_model", *order, label, *[f"_x{i}" for i in range(len(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, tuple[list, list]] = {}
        for batch in batches:
            at = batch.schema.get_field_index
            model = batch.column(at("_model")).to_numpy()
            for m in np.unique(model):
                part = batch.filter(pa.array(model == m))
                numbers, out = got.setdefault(int(m), ([], []))
                numbers.append([part.column(at(c)).to_numpy(zero_copy_only=False) for c in needed])
                out.append(part.select(names).filter(pa.array(numbers[-1][1] == folds[m])))
        for m, (numbers, out) in got.items():
            y, of, tenths, *x = (np.concatenate(c) for c in zip(*numbers, strict=True))
            numbers.clear()
            said, _ = fit_predict(np.stack(x, axis=1).astype(float), y, of != folds[m], tenths.astype(bool), classes, rounds)
            lo = 0
            for part in out:
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said[lo : lo + len(part)], pa.int32())], schema.names)
                lo += len(part)

    return dealt.mapInArrow(run, schema)
