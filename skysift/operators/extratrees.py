"""Extremely randomised trees: cut points are drawn, not sought.

For every node and feature one cut is drawn between the node's bounds on that
feature; of the features the one whose cut separates the classes best is taken.
Draws follow from the seed, the tree and the node, so tasks need no state. A level
of all trees costs one job: tasks count rows by (tree, node, feature, side, class)
over their Arrow batches, the counts are added, and the driver picks features.
What reaches it is bounded by trees x nodes x features x classes. Trees see all
rows of the parts that they use (no bootstrap), so folds share the rows and the
jobs. Bins are those of the boosting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from . import boosting

TREES, DEPTH, LEAST, SEED = 50, 8, 1, 42
HELD = 1 << 20


class ExtraTrees:
    """Trees as arrays (tree, node): feature (-1 for a leaf) and cut; shares of
    the classes (tree, node, class), of every node of every level."""

    def __init__(self, n_trees: int, n_classes: int, depth: int, n_features: int):
        nodes = (2 << depth) - 1
        self.depth, self.n_classes, self.n_features = depth, n_classes, n_features
        self.feature = np.full((n_trees, nodes), -1, np.int16)
        self.cut = np.zeros((n_trees, nodes), np.int16)
        self.share = np.full((n_trees, nodes, n_classes), 1 / n_classes)

    def place(self, b: np.ndarray) -> np.ndarray:
        """(rows, trees): the node at which every row ends in the trees so far."""
        row, tree = np.arange(len(b))[:, None], np.arange(len(self.feature))[None, :]
        node = np.zeros((len(b), len(self.feature)), np.int32)
        for _ in range(self.depth):
            f = self.feature[tree, node]
            down = 2 * node + 1 + (b[row, np.maximum(f, 0)] > self.cut[tree, node])
            node = np.where(f >= 0, down, node)
        return node


def drawn(seed: int, level: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(tree, node of the level, feature): a cut in lo .. hi - 1, where hi > lo."""
    u = np.random.default_rng([seed, level]).random(lo.shape)
    return (lo + np.floor(u * np.maximum(hi - lo, 1))).astype(np.int16)


def _rows(df: DataFrame, label: str, part: str, columns: tuple[str, ...], keep: tuple[str, ...], bins: int) -> DataFrame:
    cuts = boosting.cut_points(df, columns, bins)
    packed = F.transform(F.array(*[boosting.bin_of(c, q) for c, q in zip(columns, cuts, strict=True)]), lambda x: F.lpad(F.hex(x), 2, "0"))
    return stored(df.select(*keep, F.col(label).cast("int").alias("_y"), F.col(part).cast("int").alias("_part"), F.unhex(F.array_join(packed, "")).alias("_b")))


def _pieces(batch: pa.RecordBatch, n_features: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    at = batch.schema.get_field_index("_b")
    step = max(1, HELD // width)
    for lo in range(0, len(batch), step):
        part = batch.slice(lo, step)
        yield part, np.frombuffer(b"".join(part.column(at).to_pylist()), np.uint8).reshape(len(part), n_features)


def counted(b: np.ndarray, y: np.ndarray, used: np.ndarray, node: np.ndarray, cuts: np.ndarray, first: int, classes: int) -> np.ndarray:
    """Rows by (tree, node, feature, side, class) of the level whose nodes begin
    at first; used: (rows, trees)."""
    trees, nodes, features = cuts.shape
    here = node - first
    live = used & (here >= 0) & (here < nodes)
    r, t = np.nonzero(live)
    k = here[r, t]
    side = (b[r] > cuts[t, k]).astype(np.int64)
    place = (((t * nodes + k)[:, None] * features + np.arange(features)) * 2 + side) * classes + y[r][:, None]
    return np.bincount(place.ravel(), minlength=trees * nodes * features * 2 * classes).reshape(trees, nodes, features, 2, classes)


def chosen(n: np.ndarray, least: int) -> np.ndarray:
    """(tree, node): the feature whose drawn cut lowers the Gini impurity most,
    -1 where none does or the node is pure or small. Ties go to the first."""
    side = n.sum(axis=-1)
    whole = n.sum(axis=3)
    pure = lambda c, s: (c.astype(float) ** 2).sum(axis=-1) / np.maximum(s, 1)
    gain = pure(n, side).sum(axis=-1) - pure(whole, whole.sum(axis=-1))
    gain = np.where((side.min(axis=-1) >= least), np.round(gain, 9), -1.0)
    best = gain.argmax(axis=-1)
    return np.where(np.take_along_axis(gain, best[..., None], -1)[..., 0] > 1e-9, best, -1)


def fit(
    df: DataFrame, label: str, part: str, columns: tuple[str, ...], n_classes: int, use: np.ndarray, n_trees: int = TREES, depth: int = DEPTH, least: int = LEAST,
    seed: int = SEED, keep: tuple[str, ...] = (), bins: int = boosting.BINS,
) -> tuple[DataFrame, ExtraTrees]:
    """(rows as they are held, trees): n_trees for each row of use (models x
    parts), one model after the other."""
    rows = _rows(df, label, part, columns, keep, bins)
    use = np.repeat(np.asarray(use, bool), n_trees, axis=0)
    trees = ExtraTrees(len(use), n_classes, depth, len(columns))
    lo = np.zeros((len(use), 1, len(columns)), int)
    hi = np.full_like(lo, bins)
    for level in range(depth):
        first, nodes = (1 << level) - 1, 1 << level
        cuts = drawn(seed, level, lo, hi)
        n = _counts(rows, trees, use, cuts, first)
        total = n[:, :, 0].sum(axis=2)
        size = total.sum(axis=-1, keepdims=True)
        parent = trees.share[:, (np.arange(first, first + nodes) - 1) // 2] if level else trees.share[:, :1]
        trees.share[:, first : first + nodes] = np.where(size > 0, total / np.maximum(size, 1), parent)
        f = chosen(n, least)
        trees.feature[:, first : first + nodes] = f
        cut = np.take_along_axis(cuts, np.maximum(f, 0)[..., None], -1)[..., 0]
        trees.cut[:, first : first + nodes] = cut
        # the last level's cuts give the leaves' shares without another pass
        sides = np.take_along_axis(n, np.maximum(f, 0)[..., None, None, None], 2)[:, :, 0]
        s = sides.sum(axis=-1, keepdims=True)
        own = np.where(s > 0, sides / np.maximum(s, 1), trees.share[:, first : first + nodes][:, :, None])
        trees.share[:, 2 * first + 1 : 2 * first + 1 + 2 * nodes] = own.reshape(len(use), 2 * nodes, n_classes)
        at = np.arange(len(columns)) == f[..., None]
        left_hi, right_lo = np.where(at, cut[..., None], hi), np.where(at, cut[..., None] + 1, lo)
        lo = np.stack([lo, right_lo], axis=2).reshape(len(use), 2 * nodes, -1)
        hi = np.stack([left_hi, hi], axis=2).reshape(len(use), 2 * nodes, -1)
    return rows, trees


def _counts(rows: DataFrame, trees: ExtraTrees, use: np.ndarray, cuts: np.ndarray, first: int) -> np.ndarray:
    shape = (*cuts.shape, 2, trees.n_classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for part, b in _pieces(batch, trees.n_features, len(use) * trees.n_features):
                y, used = part.column(0).to_numpy(), use[:, part.column(1).to_numpy()].T
                total += counted(b, y, used, trees.place(b), cuts, first, trees.n_classes)
        flat = total.ravel()
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["cell", "n"])

    got = rows.select("_y", "_part", "_b").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(int(np.prod(shape)), np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(shape)


def out_of_fold(df: DataFrame, label: str, fold: str, columns: tuple[str, ...], n_classes: int, folds: int, keep: tuple[str, ...], **cols) -> DataFrame:
    """keep, _y, _part, prediction and probability of every row, by the trees that
    were grown on the other folds."""
    rows, trees = fit(df, label, fold, columns, n_classes, ~np.eye(folds, dtype=bool), keep=keep, **cols)
    per = len(trees.feature) // folds
    names = [c for c in rows.columns if c != "_b"]
    schema = rows.select(*names).schema.add("prediction", T.IntegerType()).add("probability", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, b in _pieces(batch, trees.n_features, len(trees.feature) * trees.n_classes):
                of = part.column(part.schema.get_field_index("_part")).to_numpy()[:, None] * per + np.arange(per)
                node = trees.place(b)[np.arange(len(b))[:, None], of]
                p = trees.share[of, node].mean(axis=1)
                columns = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(p.argmax(axis=1), pa.int32()), pa.array(p.tolist(), pa.list_(pa.float64()))], [*names, "prediction", "probability"])

    return rows.mapInArrow(run, schema)
