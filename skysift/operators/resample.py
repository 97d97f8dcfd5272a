"""Poisson bootstraps with many replicates in one pass over the rows.

A row's weight in a replicate follows from its id and the replicate's number.
Tasks work the weights of all replicates out as a matrix, a block of rows at a
time, and keep one number for each replicate: rows are neither copied nor
exploded. For means that is a sum. For the AUROC the rows are dealt to ranges of
the score, sorted there and streamed: a range yields, for each replicate, its
weights of both classes and its pairs won, and the ranges before it add theirs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REPLICATES, SEED, ALPHA = 1000, 42, 0.05
#: Weights that are held at once in a task.
HELD = 1 << 21

_U = np.uint64
#: Cumulative probabilities of 0, 1, 2 ... under a Poisson law of mean 1.
_CDF = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer (new array)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def weights(h: np.ndarray, replicates: int) -> np.ndarray:
    """(rows, replicates + 1): the weights of rows by the hash of their id. The
    first column is the sample itself: 1."""
    r = np.arange(replicates + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    u = (_mixed(h.view(_U)[:, None] + r) >> _U(11)).astype(np.float64) / float(1 << 53)
    out = np.searchsorted(_CDF, u, side="right").astype(np.float64)
    out[:, 0] = 1.0
    return out


def _hash(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_col), F.lit(seed))


def mean(df: DataFrame, value: str, id_col: str, replicates: int = REPLICATES, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """(n, mean, low, high): percentile interval of the mean of the values that
    are not null; under two of them there is no interval."""
    rows = df.where(F.col(value).isNotNull()).select(_hash(id_col, seed).alias("h"), F.col(value).cast("double").alias("x"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, replicates + 1))
        step = max(1, HELD // (replicates + 1))
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                w = weights(part.column(0).to_numpy(), replicates)
                total += np.stack([part.column(1).to_numpy() @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(replicates + 1)), *map(pa.array, total)], ["r", "wx", "w"])

    each = rows.mapInArrow(sums, "r long, wx double, w double").groupBy("r").agg(F.sum("wx").alias("wx"), F.sum("w").alias("w"))
    each = each.select("r", "w", (F.col("wx") / F.nullif("w", F.lit(0.0))).alias("m"))
    return _interval(each, "m", alpha).select(F.coalesce("size", F.lit(0.0)).cast("long").alias("n"), F.col("m").alias("mean"), *[F.when(F.col("size") > 1, F.col(c)).alias(c) for c in ("low", "high")])


def _interval(each: DataFrame, value: str, alpha: float) -> DataFrame:
    """One row from a row for each replicate: size, the value of the sample, and
    the ends of the interval."""
    of = F.when(F.col("r") > 0, F.col(value))
    return each.agg(
        F.max(F.when(F.col("r") == 0, F.col("w"))).alias("size"), F.max(F.when(F.col("r") == 0, F.col(value))).alias(value),
        F.percentile(of, alpha / 2).alias("low"), F.percentile(of, 1 - alpha / 2).alias("high"),
    )


def auroc(df: DataFrame, score: str, positive: str, id_col: str, replicates: int = REPLICATES, seed: int = SEED, alpha: float = ALPHA) -> DataFrame:
    """(n, auroc, low, high): percentile interval of the area under the ROC curve,
    ties counting half; null without rows of both classes."""
    rows = df.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(positive).cast("int").alias("y"), _hash(id_col, seed).alias("h"))
    dealt = rows.repartitionByRange("s").sortWithinPartitions("s")

    def won(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = replicates + 1
        pos, neg, pairs, tie, at, first = np.zeros(k), np.zeros(k), np.zeros(k), np.zeros((2, k)), None, None
        step = max(1, HELD // k)

        def close() -> None:
            """Adds the tie that is open: what it wins lies below it, or in it by half."""
            nonlocal pos, neg, pairs
            pairs = pairs + tie[1] * (neg + tie[0] / 2)
            pos, neg = pos + tie[1], neg + tie[0]

        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                s, y, w = part.column(0).to_numpy(), part.column(1).to_numpy(), weights(part.column(2).to_numpy(), replicates)
                if first is None:
                    first = float(s[0])
                begin = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
                by = [np.add.reduceat(np.where((y == c)[:, None], w, 0.0), begin, axis=0) for c in (0, 1)]
                for i, v in enumerate(s[begin]):
                    if v != at:
                        close()
                        tie, at = np.zeros((2, k)), v
                    tie = tie + np.stack([by[0][i], by[1][i]])
        close()
        if first is not None:
            columns = [pa.array([first] * k), pa.array(np.arange(k)), pa.array(pos), pa.array(neg), pa.array(pairs)]
            yield pa.RecordBatch.from_arrays(columns, ["first", "r", "pos", "neg", "pairs"])

    ranges = dealt.mapInArrow(won, "first double, r long, pos double, neg double, pairs double")
    below = F.coalesce(F.sum("neg").over(W.partitionBy("r").orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))  # a row for each range
    each = ranges.withColumn("won", F.col("pairs") + F.col("pos") * below).groupBy("r").agg(F.sum("won").alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    each = each.select("r", (F.col("p") + F.col("q")).alias("w"), (F.col("won") / F.nullif(F.col("p") * F.col("q"), F.lit(0.0))).alias("auroc"))
    return _interval(each, "auroc", alpha).select(F.coalesce("size", F.lit(0.0)).cast("long").alias("n"), "auroc", "low", "high")
