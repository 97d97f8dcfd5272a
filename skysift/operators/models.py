"""Distance and density models. Fits reduce the table to moments by one or two
partial aggregations; only D x D matrices reach the driver. Scores are column
expressions over a small literal matrix, so scoring shuffles nothing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread, stored
from .rank import quantiles


#: Rows whose Fourier features a task holds at once.
STEP = 2048


def _sums(columns: tuple[str, ...], w: Column) -> list[Column]:
    """n, sums, sums of products and of |x|^4, as aggregates; bounded by D^2."""
    square = sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0]))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    return [
        F.sum(w).alias("n"), *[F.sum(w * F.col(c)).alias(f"s{i}") for i, c in enumerate(columns)],
        *[F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"q{i}_{j}") for i, j in pairs], F.sum(w * square * square).alias("four"),
    ]


def _moments_of(row, d: int):
    n = float(row["n"] or 0)
    q = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            q[i, j] = q[j, i] = float(row[f"q{i}_{j}"] or 0)
    mean = np.array([float(row[f"s{i}"] or 0) for i in range(d)]) / max(n, 1e-300)
    return n, mean, q, float(row["four"] or 0)


def moments(df: DataFrame, columns: tuple[str, ...], weight: Column | None = None):
    """(n, mean, X'X, sum of |x|^4) about 0 in one aggregation."""
    w = weight if weight is not None else F.lit(1.0)
    return _moments_of(df.agg(*_sums(columns, w)).first(), len(columns))


def moments_by(df: DataFrame, columns: tuple[str, ...], label: str, centres: dict) -> dict:
    """The moments of every class about its centre, all in one aggregation."""
    at = F.create_map(*[x for y, m in centres.items() for x in (F.lit(y), F.array(*[F.lit(float(v)) for v in m]))])
    off = df.select(label, *[(F.col(c) - at[F.col(label)][i]).alias(c) for i, c in enumerate(columns)])
    return {r[label]: _moments_of(r, len(columns)) for r in off.groupBy(label).agg(*_sums(columns, F.lit(1.0))).collect()}  # a row for each class


def ledoit_wolf(n: float, q: np.ndarray, four: float) -> np.ndarray:
    """Shrunk covariance of centred data from its sums (Ledoit and Wolf 2004)."""
    p = len(q)
    s = q / n
    mu = np.trace(s) / p
    norm = float((s * s).sum())
    delta = (norm - 2 * mu * np.trace(s) + p * mu * mu) / p
    beta = (four / n - norm) / (p * n)
    shrink = min(beta, delta) / delta if delta > 0 else 1.0
    return (1 - shrink) * s + shrink * mu * np.eye(p)


def quadratic(columns: tuple[str, ...], centre: np.ndarray, precision: np.ndarray) -> Column:
    """(x - centre)' precision (x - centre) as an expression."""
    d = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, centre, strict=True)]
    out = F.lit(0.0)
    for i, x in enumerate(d):
        row = sum((F.lit(float(precision[i, j])) * d[j] for j in range(1, len(d))), F.lit(float(precision[i, 0])) * d[0])
        out = out + x * row
    return out


@dataclass
class Detector:
    """Per class a centre and a shrunk precision; the score is the smallest
    Mahalanobis distance over classes."""

    columns: tuple[str, ...]
    shift: np.ndarray
    scale: np.ndarray
    classes: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, df: DataFrame, label: str, columns: tuple[str, ...], centre: str = "median") -> Detector:
        s = df.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        shift = np.array([float(s[f"a{i}"]) for i in range(len(columns))])
        scale = np.array([float(s[f"s{i}"]) if s[f"s{i}"] > 1e-12 else 1.0 for i in range(len(columns))])
        z = df.select(label, *[((F.col(c) - float(m)) / float(k)).alias(c) for c, m, k in zip(columns, shift, scale, strict=True)])
        if centre == "median":
            q = quantiles(z, columns, (0.5,), (label,))
            z_centres = q.groupBy(label).agg(*[F.max(F.when(F.col("column") == c, F.col("q0"))).alias(c) for c in columns])
        else:
            z_centres = z.groupBy(label).agg(*[F.avg(c).alias(c) for c in columns])
        centres = {r[label]: np.array([float(r[c]) for c in columns]) for r in z_centres.collect()}  # a row for each class
        classes = {}
        for y, (n, _, q, four) in moments_by(z.where(F.col(label).isNotNull()), columns, label, {k: m for k, m in centres.items() if k is not None}).items():
            m = centres[y]
            classes[y] = (m, np.linalg.inv(ledoit_wolf(n, q, four)) if n >= 2 else np.eye(len(columns)))
        return cls(columns, shift, scale, classes)

    def score(self, df: DataFrame, name: str = "score") -> DataFrame:
        s = np.diag(1 / self.scale)
        each = [F.sqrt(F.greatest(quadratic(self.columns, self.shift + m * self.scale, s @ p @ s), F.lit(0.0))) for m, p in self.classes.values()]
        return df.withColumn(name, F.least(*each) if len(each) > 1 else each[0])


@dataclass
class Mixture:
    """A Gaussian mixture of one class in z-space; log density without the
    Jacobian of the standardisation."""

    columns: tuple[str, ...]
    shift: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, columns: tuple[str, ...], components: int, seed: int = 42) -> Mixture:
        from pyspark.ml.clustering import GaussianMixture
        from pyspark.ml.feature import VectorAssembler

        s = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
        k = min(components, max(1, int(s["n"]) // 20))
        shift = np.array([float(s[f"a{i}"]) for i in range(len(columns))])
        scale = np.array([float(s[f"s{i}"]) or 1e-6 for i in range(len(columns))])
        z = df.select(*[((F.col(c) - float(m)) / float(v)).alias(c) for c, m, v in zip(columns, shift, scale, strict=True)])
        if k == 1:
            n, mean, q, _ = moments(z, columns)
            return cls(columns, shift, scale, np.ones(1), mean[None], (q / n - np.outer(mean, mean))[None] + 1e-6 * np.eye(len(columns)))
        model = GaussianMixture(k=k, seed=seed, maxIter=100).fit(VectorAssembler(inputCols=list(columns), outputCol="features").transform(spread(z)))
        g = model.gaussiansDF.collect()  # one row per component
        covs = np.array([np.array(r["cov"].toArray()) for r in g]) + 1e-6 * np.eye(len(columns))
        return cls(columns, shift, scale, np.array(model.weights), np.array([r["mean"].toArray() for r in g]), covs)

    def log_density(self) -> Column:
        """One vectorised function: written out as an expression, five components
        take longer to plan than to score."""
        d = len(self.columns)
        shift, scale, means, factors = self.shift, self.scale, self.means, [np.linalg.inv(np.linalg.cholesky(c)) for c in self.covs]
        const = [math.log(max(w, 1e-300)) - 0.5 * d * math.log(2 * math.pi) + np.log(np.diag(f)).sum() for w, f in zip(self.weights, factors, strict=True)]

        @F.pandas_udf("double")
        def density(*x: pd.Series) -> pd.Series:
            z = (np.stack([c.to_numpy(float) for c in x], axis=1) - shift) / scale
            terms = np.stack([k - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for k, m, f in zip(const, means, factors, strict=True)])
            return pd.Series(np.logaddexp.reduce(terms, axis=0))

        return density(*[F.col(c) for c in self.columns])


def fit_mixtures(df: DataFrame, label: str, columns: tuple[str, ...], components: int = 4) -> dict[int, Mixture]:
    """One mixture per class (classes are few)."""
    names = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    return {y: Mixture.fit(df.where(F.col(label) == y), columns, components) for y in names}


def log_prob(df: DataFrame, mixtures: dict[int, Mixture], name: str = "log_prob") -> DataFrame:
    """Adds the largest log density over classes and that of each class."""
    out = df.withColumns({f"{name}_{y}": m.log_density() for y, m in mixtures.items()})
    each = [F.col(f"{name}_{y}") for y in mixtures]
    return out.withColumn(name, F.greatest(*each) if len(each) > 1 else each[0])


def on_manifold(df: DataFrame, floor: Column, score: str = "log_prob", margin: float = 5.0) -> DataFrame:
    """Adds ood: below the lowest score of the fitted rows by the margin."""
    return df.withColumn("ood", F.col(score) < floor - margin)


def pca(df: DataFrame, columns: tuple[str, ...], k: int = 2) -> DataFrame:
    """Adds pc1 .. pck of the standardised columns; each axis points to where
    its largest weight is positive."""
    s = df.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    shift = np.array([float(s[f"a{i}"]) for i in range(len(columns))])
    scale = np.array([float(s[f"s{i}"]) if s[f"s{i}"] > 1e-12 else 1.0 for i in range(len(columns))])
    z = df.withColumns({f"_z{i}": (F.col(c) - float(shift[i])) / float(scale[i]) for i, c in enumerate(columns)})
    n, _, q, _ = moments(z, tuple(f"_z{i}" for i in range(len(columns))))
    values, vectors = np.linalg.eigh(q / n)
    out = z
    for i in range(k):
        v = vectors[:, -1 - i]
        v = v * np.sign(v[np.argmax(np.abs(v))])
        out = out.withColumn(f"pc{i + 1}", sum((F.col(f"_z{j}") * float(v[j]) for j in range(1, len(v))), F.col("_z0") * float(v[0])))
    return out.drop(*[f"_z{i}" for i in range(len(columns))])


def ensemble(label: str, rounds: int = 100):
    """The boosted ensemble: 100 rounds of depth 6, 20 rows a leaf at least."""
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=6, minInstancesPerNode=20, seed=42)


def ensemble_pipeline(label: str, columns: tuple[str, ...], rounds: int = 100):
    """Assembler, scaler and the boosted ensemble, as one model to save and load."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    own = ensemble(label, rounds).setFeaturesCol("scaled")
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True), own])


def probabilities(df: DataFrame, estimator, columns: tuple[str, ...], name: str = "prob") -> DataFrame:
    """Adds the probability of class 1 by an estimator that is fitted on df."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = spread(stored(VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)))
    got = estimator.fit(rows).transform(rows).withColumn(name, vector_to_array("probability")[1])
    return got.drop("features", "rawPrediction", "probability", "prediction")


def fourier(df: DataFrame, columns: tuple[str, ...], m: int = 256, gamma: float | None = None, seed: int = 42, name: str = "kernel") -> DataFrame:
    """Adds an array of m random Fourier features of the standardised columns:
    products of two rows' arrays come near the kernel exp(-gamma |x - y|^2), with
    an error of order 1 / sqrt(m). gamma is 1 / columns if it is not given. A
    linear fit on them is a kernel machine whose fit needs no kernel matrix. A task
    holds the arrays of STEP rows, however many rows a batch has."""
    s = df.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    shift = np.array([float(s[f"a{i}"] or 0) for i in range(len(columns))])
    scale = np.array([float(s[f"s{i}"]) if (s[f"s{i}"] or 0) > 1e-12 else 1.0 for i in range(len(columns))])
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((len(columns), m)) * math.sqrt(2 * (gamma if gamma is not None else 1 / len(columns)))
    b = rng.uniform(0, 2 * math.pi, m)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), STEP):
                part = batch.slice(lo, STEP)
                x = [part.column(part.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]
                out = math.sqrt(2 / m) * np.cos((np.stack(x, axis=1) - shift) / scale @ w + b)
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * m, pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], [*part.schema.names, name])

    return df.mapInArrow(mapped, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def out_of_fold(df: DataFrame, estimator, label: str, columns: tuple[str, ...], id_col: str, folds: int = 3) -> DataFrame:
    """(id, label, fold, prediction): each fold predicted by a model that is
    fitted on the others. estimator is a pyspark.ml classifier."""
    from pyspark.ml.feature import VectorAssembler

    from .splits import kfold

    rows = spread(stored(VectorAssembler(inputCols=list(columns), outputCol="features").transform(kfold(df, id_col, label, folds))))
    out = None
    for k in range(folds):
        model = estimator.fit(rows.where(F.col("fold") != k))
        part = model.transform(rows.where(F.col("fold") == k)).select(id_col, label, "fold", F.col("prediction").cast("int").alias("prediction"))
        out = part if out is None else out.unionByName(part)
    return out


#: Rows of a part of a forest's table: trees are grown level by level, and every
#: part sends the counts of all nodes of a level, so that more parts cost more.
FOREST_PARTS, FOREST_ROWS = 12, 1 << 18


def imputed_out_of_fold(df: DataFrame, estimator, label: str, fold: str, columns: tuple[str, ...], folds: list[int]) -> DataFrame:
    """(label, prediction): each of folds predicted by a pyspark.ml classifier that
    is fitted on the others, whose medians stand for values that are missing or not
    finite (0 where a column has none). A fold's predictions are written before the
    next model is fitted: the driver holds one model at a time."""
    from pyspark.ml.feature import VectorAssembler

    finite = lambda c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c))  # noqa: E731  NaN is the largest
    rows = df.select(label, fold, *[finite(c).cast("double").alias(c) for c in columns])
    n = df.count()
    rows = stored(rows.repartition(max(FOREST_PARTS, -(-n // FOREST_ROWS))))
    middle = {}
    if rows.where(F.greatest(*[F.col(c).isNull().cast("int") for c in columns]) == 1).limit(1).count():
        each = rows.withColumn("_model", F.explode(F.array(*[F.lit(k) for k in folds]))).where(F.col(fold) != F.col("_model"))
        middle = {(r["_model"], r["column"]): r["q0"] for r in quantiles(each, columns, (0.5,), ("_model",)).collect()}  # folds x columns
    out = None
    for k in folds:
        whole = rows.select(label, fold, *[F.coalesce(F.col(c), F.lit(float(middle.get((k, c), 0.0)))).alias(c) for c in columns])
        whole = VectorAssembler(inputCols=list(columns), outputCol="features").transform(whole)
        model = estimator.fit(whole.where(F.col(fold) != k))
        part = stored(model.transform(whole.where(F.col(fold) == k)).select(label, F.col("prediction").cast("int").alias("prediction")))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.select(label, F.lit(0).alias("prediction"))
