"""Multiclass gradient boosting on softmax trees, many models at once.

Features are cut into bins once. A round adds a tree for every class of every
model; a level of all these trees costs one job: each task sums gradients,
hessians and rows by (model, class, node, feature, bin) over its Arrow batches,
one aggregation adds the tasks' sums, and the driver picks the splits. What
reaches the driver is bounded by models x classes x nodes x features x bins,
whatever the number of rows, and the last level's sums already give the leaves.

Models share the rows: model m is fitted on the rows whose ``part`` it uses, so
folds, or the cells of a grid times its folds, are models of one fit. Raw scores
of all models stand in the row; they are written anew every ``KEEP`` rounds,
and tasks work out the rounds since then from the trees. Nothing is sampled.

Missing values and NaN have a bin of their own, the lowest. Without any split
that gains, a node stays whole. Ties go to the first feature and the lowest cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored

#: Bins of a feature (the missing one comes on top), rounds between writings of
#: the raw scores, and raw scores that are held at once in a task.
BINS, KEEP, HELD = 32, 25, 1 << 18
#: Raw scores that are worth a task of their own, and most rows of a task.
TASK, PART_ROWS = 1 << 12, 1 << 20
#: Files of a table up to which the tasks' sums come to the driver one by one.
FEW = 16
#: Least hessian of a leaf and least gain of a split.
LEAST_HESSIAN, LEAST_GAIN = 1e-3, 1e-9


def cut_points(df: DataFrame, columns: tuple[str, ...], bins: int = BINS) -> list[list[float]]:
    """Cuts of each column at approximate quantiles of its values, ascending."""
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    row = df.agg(*[F.percentile_approx(value(c), at, F.lit(100 * bins)).alias(f"q{i}") for i, c in enumerate(columns)]).first()
    return [sorted(set(q or [])) for q in row]


def bin_of(column: str, cuts: list[float]) -> Column:
    """0 for a missing value, else 1 and the number of cuts below the value."""
    x = F.col(column).cast("double")
    ends = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    return F.when(x.isNull() | F.isnan(x), 0).otherwise(F.size(F.filter(ends, lambda c: c < x)) + 1)


@dataclass
class Plan:
    """What is fitted: use[m, p] tells whether model m is fitted on part p; rate,
    l2, least (rows of a leaf) and depth are numbers of all or of each model."""

    use: np.ndarray
    n_classes: int
    rate: np.ndarray | float = 0.1
    l2: np.ndarray | float = 0.0
    least: np.ndarray | float = 20
    depth: np.ndarray | int = 3

    def __post_init__(self):
        self.use = np.asarray(self.use, bool)
        for name in ("rate", "l2", "least", "depth"):
            setattr(self, name, np.broadcast_to(np.asarray(getattr(self, name), float), (len(self.use),)))

    @property
    def levels(self) -> int:
        return int(self.depth.max())


@dataclass
class Trees:
    """Trees of every round: feature and highest bin of the left side by model,
    class and node (nodes of a level in order), and values of the leaves."""

    base: np.ndarray
    feature: list[np.ndarray] = field(default_factory=list)
    bin: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def add(self, feature: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        self.feature.append(feature)
        self.bin.append(at)
        self.value.append(value)


def _walk(b: np.ndarray, feature: np.ndarray, at: np.ndarray, levels: int) -> np.ndarray:
    """The node of every row (of bins b) in the trees of a round, after levels.
    All nodes are asked, each with whole columns of bytes: that is many times
    faster than to look up the one node of every row and tree."""
    trees = feature.reshape(-1, feature.shape[-1])
    cuts = np.minimum(at.reshape(trees.shape), 255).astype(np.uint8)
    column, kind = np.ascontiguousarray(b.T), np.uint8 if levels <= 8 else np.int32

    def below(node: int, left: int) -> np.ndarray:
        right = column[trees[:, node]] > cuts[:, node, None]
        if left == 1:
            return right.astype(kind)
        return np.where(right, below(2 * node + 2, left - 1) + kind(1 << (left - 1)), below(2 * node + 1, left - 1))

    return (below(0, levels) if levels else np.zeros((len(trees), len(b)), kind)).T


def advance(raw: np.ndarray, b: np.ndarray, feature: list, at: list, value: list) -> np.ndarray:
    """Raw scores (rows, models, classes) after more rounds. Trees of the first of
    two classes alone stand, with the sign turned, for the second as well."""
    if not feature or not len(b):
        return raw
    grown = value[0].shape[1]
    out = np.ascontiguousarray(raw.transpose(1, 2, 0))  # a line of rows for each tree
    first = np.arange(out.shape[0] * grown)[:, None]
    for f, c, v in zip(feature, at, value, strict=True):
        leaf = _walk(b, f, c, int(np.log2(v.shape[-1]))).T + first * v.shape[-1]
        step = v.ravel().take(leaf).reshape(-1, grown, len(b))
        out[:, :grown] += step
        if grown < out.shape[1]:
            out[:, 1:] -= step
    return np.ascontiguousarray(out.transpose(2, 0, 1))


def n_tasks(df: DataFrame, rows: int, per_row: int) -> int:
    """Tasks that the rows of a fit are dealt to: by the raw scores, which are what
    a row costs, not by the bytes, which are few; up to the cores there are, or
    more where a task would have over PART_ROWS rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(cores, -(-rows * per_row // TASK)), -(-rows // PART_ROWS))


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def histograms(b: np.ndarray, y: np.ndarray, used: np.ndarray, raw: np.ndarray, node: np.ndarray, nodes: int, bins: int, grown: int | None = None) -> np.ndarray:
    """Sums (model, class, node, feature, bin, 3) of gradients, hessians and rows
    of the first ``grown`` classes (if not given, of all), a feature at a time."""
    n, models, classes = raw.shape
    grown = grown or classes
    p = softmax(raw)
    g = (p - (y[:, None] == np.arange(classes))[:, None, :])[:, :, :grown]
    h = (p * (1 - p))[:, :, :grown]
    live = np.repeat(used, grown, axis=1)
    row = np.nonzero(live)[0]
    place = (np.arange(models * grown)[None, :] * nodes + node)[live] * bins
    g, h = g.reshape(n, -1)[live], h.reshape(n, -1)[live]
    out = np.empty((models * grown * nodes, b.shape[1], bins, 3))
    for f in range(b.shape[1]):
        at = place + b[row, f]
        for k, w in enumerate((g, h, None)):
            out[:, f, :, k] = np.bincount(at, w, len(out) * bins).reshape(-1, bins)
    return out.reshape(models, grown, nodes, b.shape[1], bins, 3)


def best_splits(hist: np.ndarray, plan: Plan, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, highest bin on the left, sums of both sides) of every node; a
    node that is not split has all rows on the left."""
    left = hist.cumsum(axis=4)
    total = left[:, :, :, :1, -1:, :]
    right = total - left
    per = lambda v: v[:, None, None, None, None]
    score = lambda s: s[..., 0] ** 2 / np.maximum(s[..., 1] + per(plan.l2), 1e-12)
    gain = score(left) + score(right) - score(total)
    ok = (np.minimum(left[..., 2], right[..., 2]) >= per(plan.least)) & (np.minimum(left[..., 1], right[..., 1]) >= LEAST_HESSIAN) & (per(plan.depth) > level)
    gain = np.where(ok, np.round(gain, 9), -1.0)
    flat = gain.reshape(*gain.shape[:3], -1)
    best = flat.argmax(axis=-1)
    split = np.take_along_axis(flat, best[..., None], -1)[..., 0] > LEAST_GAIN
    bins = hist.shape[4]
    feature, at = np.where(split, best // bins, 0), np.where(split, best % bins, bins)
    chosen = np.take_along_axis(left.reshape(*gain.shape[:3], -1, 3), best[..., None, None], 3)[..., 0, :]
    whole = total[:, :, :, 0, 0, :]
    chosen = np.where(split[..., None], chosen, whole)
    return feature, at, np.stack([chosen, whole - chosen], axis=3)


def leaves(sides: np.ndarray, plan: Plan) -> np.ndarray:
    """Values (model, class, leaf) from the sums of the last level's sides."""
    per = lambda v: v[:, None, None, None]
    g, h = sides[..., 0], sides[..., 1]
    value = np.where(h > 0, -per(plan.rate) * g / np.maximum(h + per(plan.l2), 1e-12), 0.0)
    return value.reshape(*value.shape[:2], -1)


def states(batch: pa.RecordBatch, trees: Trees, held: bool, n_features: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch: (rows, bins, raw scores). Rows hold the raw scores before
    the rounds of trees, or none if these are all rounds."""
    models, classes = trees.base.shape
    step = max(1, HELD // (models * classes))
    at_b, at_raw = batch.schema.get_field_index("_b"), batch.schema.get_field_index("_raw")
    for lo in range(0, len(batch), step):
        part = batch.slice(lo, step)
        b = np.frombuffer(b"".join(part.column(at_b).to_pylist()), np.uint8).reshape(len(part), n_features)
        if held:
            raw = np.frombuffer(b"".join(part.column(at_raw).to_pylist()), np.float64).reshape(len(part), models, classes)
        else:
            raw = np.broadcast_to(trees.base, (len(part), models, classes))
        yield part, b, advance(raw, b, trees.feature, trees.bin, trees.value)


class Boosted:
    """A fit: ``fit`` builds it, ``scores`` gives rows and their raw scores."""

    def __init__(self, rows: DataFrame, trees: Trees, plan: Plan, n_features: int, bins: int):
        self.rows, self.trees, self.plan, self.n_features, self.bins = rows, trees, plan, n_features, bins
        self._since = 0  # rounds that the rows' raw scores hold
        self._files = len(rows.inputFiles())

    @classmethod
    def fit(cls, df: DataFrame, label: str, part: str, columns: tuple[str, ...], plan: Plan, rounds: int, keep: tuple[str, ...] = (), bins: int = BINS) -> Boosted:
        """df: label (0 .. classes - 1), part (0 .. parts - 1, a column of
        plan.use), features; keep: columns to carry along."""
        cuts = cut_points(df, columns, bins)
        packed = F.transform(F.array(*[bin_of(c, q) for c, q in zip(columns, cuts, strict=True)]), lambda x: F.lpad(F.hex(x), 2, "0"))
        rows = df.select(*keep, F.col(label).cast("int").alias("_y"), F.col(part).cast("int").alias("_part"), F.unhex(F.array_join(packed, "")).alias("_b"))
        rows = stored(rows)
        counts = np.zeros((plan.use.shape[1], plan.n_classes))
        for r in rows.groupBy("_part", "_y").count().collect():  # parts x classes
            counts[r["_part"], r["_y"]] = r["count"]
        prior = np.maximum(plan.use @ counts, 1e-9)
        base = np.log(prior / np.maximum(prior.sum(axis=1, keepdims=True), 1e-9))
        rows = stored(rows.repartition(n_tasks(rows, int(counts.sum()), base.size)).withColumn("_raw", F.lit(None).cast("binary")))
        out = cls(rows, Trees(base), plan, len(columns), bins + 1)
        for _ in range(rounds):
            out._round()
        return out

    @property
    def grown(self) -> int:
        """Classes that trees are grown for: of two classes one is enough, since the
        gradients of the other are the same with the sign turned."""
        classes = self.plan.n_classes
        return 1 if classes == 2 else classes

    def _left(self) -> tuple[Trees, bool, int]:
        """What tasks need: the rounds that the rows' raw scores lack."""
        t, k = self.trees, self._since
        return Trees(t.base, t.feature[k:], t.bin[k:], t.value[k:]), k > 0, self.n_features

    def _round(self) -> None:
        models, grown = len(self.trees.base), self.grown
        levels = self.plan.levels
        feature, at = (np.zeros((models, grown, (1 << levels) - 1), np.int16) for _ in range(2))
        for level in range(levels):
            hist = self._sums(feature, at, level)
            nodes = 1 << level
            f, c, sides = best_splits(hist, self.plan, level)
            feature[:, :, nodes - 1 : 2 * nodes - 1], at[:, :, nodes - 1 : 2 * nodes - 1] = f, c
        self.trees.add(feature, at, leaves(sides, self.plan))
        if len(self.trees.value) - self._since >= KEEP:
            self.rows = stored(self._with_raw())
            self._since = len(self.trees.value)

    def _sums(self, feature: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        """The sums of a level of the trees that are being grown: one job."""
        plan, left, bins = self.plan, self._left(), self.bins
        grown = self.grown
        shape = (len(self.trees.base), grown, 1 << level, self.n_features, bins, 3)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for part, b, raw in states(batch, *left):
                    y, used = part.column(0).to_numpy(), plan.use[:, part.column(1).to_numpy()].T
                    total += histograms(b, y, used, raw, _walk(b, feature, at, level), 1 << level, bins, grown)
            flat = total.reshape(-1, 3)
            some = np.flatnonzero(flat[:, 2])
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(flat[some, k]) for k in range(3))], ["cell", "g", "h", "n"])

        each = self.rows.select("_y", "_part", "_b", "_raw").mapInArrow(sums, "cell long, g double, h double, n double")
        if self._files > FEW:
            each = each.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
        got = each.toArrow()
        out = np.zeros((int(np.prod(shape[:-1])), 3))
        np.add.at(out, got.column("cell").to_numpy(), np.stack([got.column(k).to_numpy() for k in ("g", "h", "n")], axis=1))
        return out.reshape(shape)

    def _with_raw(self) -> DataFrame:
        left, schema = self._left(), self.rows.schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, _, raw in states(batch, *left):
                    at = part.schema.get_field_index("_raw")
                    yield part.set_column(at, "_raw", pa.array([x.tobytes() for x in np.ascontiguousarray(raw)], pa.binary()))

        return self.rows.mapInArrow(run, schema)

    def probabilities(self, model_of_part: list[int]) -> DataFrame:
        """The carried columns, _y, _part, and of the model that is named for the
        row's part: prediction and probability (array)."""
        left = self._left()
        chosen = np.asarray(model_of_part)
        names = [c for c in self.rows.columns if c not in ("_b", "_raw")]
        schema = self.rows.select(*names).schema.add("prediction", T.IntegerType()).add("probability", T.ArrayType(T.DoubleType()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, _, raw in states(batch, *left):
                    of = chosen[part.column(part.schema.get_field_index("_part")).to_numpy()]
                    p = softmax(raw[np.arange(len(part)), of])
                    columns = [part.column(part.schema.get_field_index(c)) for c in names]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(p.argmax(axis=1), pa.int32()), pa.array(p.tolist(), pa.list_(pa.float64()))], [*names, "prediction", "probability"]
                    )

        return self.rows.mapInArrow(run, schema)

    def every_prediction(self) -> DataFrame:
        """(_y, _part, model, prediction, n): rows counted by what each model says
        of them; parts x models x classes squared at most."""
        left = self._left()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part, _, raw in states(batch, *left):
                    models = raw.shape[1]
                    at = [np.repeat(part.column(part.schema.get_field_index(c)).to_numpy(), models) for c in ("_y", "_part")]
                    rows = np.stack([*at, np.tile(np.arange(models), len(part)), raw.argmax(axis=2).ravel()], axis=1)
                    some, n = np.unique(rows, axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array(some[:, k], pa.int32()) for k in range(4)), pa.array(n)], ["_y", "_part", "model", "prediction", "n"])

        each = self.rows.mapInArrow(run, "_y int, _part int, model int, prediction int, n long")
        return each.groupBy("_y", "_part", "model", "prediction").agg(F.sum("n").alias("n"))


def fit_sample(b: np.ndarray, y: np.ndarray, plan: Plan, rounds: int, bins: int) -> Trees:
    """The trees of a small sample that is at hand: bins (rows, features) below
    ``bins`` and labels, every row used by every model."""
    used = np.ones((len(b), len(plan.use)), bool)
    counts = np.bincount(y, minlength=plan.n_classes).astype(float)
    base = np.log(np.maximum(counts, 1e-9) / max(len(y), 1e-9))
    trees = Trees(np.tile(base, (len(plan.use), 1)))
    raw = np.broadcast_to(trees.base, (len(b), *trees.base.shape))
    levels = plan.levels
    for _ in range(rounds):
        feature, at = (np.zeros((*trees.base.shape, (1 << levels) - 1), np.int16) for _ in range(2))
        for level in range(levels):
            hist = histograms(b, y, used, raw, _walk(b, feature, at, level), 1 << level, bins)
            nodes = slice((1 << level) - 1, (2 << level) - 1)
            feature[:, :, nodes], at[:, :, nodes], sides = best_splits(hist, plan, level)
        trees.add(feature, at, leaves(sides, plan))
        raw = advance(raw, b, trees.feature[-1:], trees.bin[-1:], trees.value[-1:])
    return trees


def out_of_fold(df: DataFrame, label: str, fold: str, columns: tuple[str, ...], n_classes: int, folds: int, rounds: int, keep: tuple[str, ...], **plan) -> DataFrame:
    """Every row predicted by the model that is fitted on the other folds."""
    model = Boosted.fit(df, label, fold, columns, Plan(~np.eye(folds, dtype=bool), n_classes, **plan), rounds, keep)
    return model.probabilities(list(range(folds)))
