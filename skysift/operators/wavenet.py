"""A small convolutional network over waveforms, trained shard by shard.

Waves are dealt to shards by a hash of their id; a shard holds about SHARD waves.
In an epoch every shard runs minibatch Adam from the common state, then states
are averaged, weighted by rows. With one shard that is plain Adam. The state
(weights and both moments, about 100,000 numbers) is all that reaches the driver;
it is averaged in Spark by position. Scoring is one Arrow pass without a shuffle.

Edge cases: samples that are not finite count as 0 and are clipped; waves of
another length are placeholders, which neither train nor score: they have 1/3
for each class, as all waves have before training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

CLASSES, CLIP, SHARD = 3, 1e3, 4096


def shapes(length: int) -> dict[str, tuple[int, ...]]:
    flat = 16 * (length // 4)
    return {"k1": (8, 1, 5), "c1": (8,), "k2": (16, 8, 3), "c2": (16,), "w1": (flat, 32), "b1": (32,), "w2": (32, CLASSES), "b2": (CLASSES,)}


def _split(flat: np.ndarray, length: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(length).items():
        size = int(np.prod(shape))
        out[name], at = flat[at : at + size].reshape(shape), at + size
    return out


def _around(x: np.ndarray, k: int) -> np.ndarray:
    """(rows, channels, places, k): what lies around every place, 0 outside."""
    return sliding_window_view(np.pad(x, ((0, 0), (0, 0), (k // 2, k // 2))), k, axis=2)


def _layer(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray):
    """Convolution, rectifier and pooling by two; with what the way back needs."""
    seen = _around(x, kernel.shape[2])
    y = np.maximum(np.einsum("bclk,ock->bol", seen, kernel, optimize=True) + bias[:, None], 0)
    pairs = y[:, :, : y.shape[2] // 2 * 2].reshape(*y.shape[:2], -1, 2)
    return pairs.max(axis=3), (seen, y, pairs.argmax(axis=3))


def _layer_back(d: np.ndarray, kept, kernel: np.ndarray):
    """(gradient of the input, of the kernel, of the bias)."""
    seen, y, which = kept
    up = np.zeros_like(y)
    up[:, :, : 2 * d.shape[2]] = (d[..., None] * (which[..., None] == np.arange(2))).reshape(*d.shape[:2], -1)
    up *= y > 0
    back = np.einsum("bolk,ock->bcl", _around(up, kernel.shape[2]), kernel[:, :, ::-1], optimize=True)
    return back, np.einsum("bol,bclk->ock", up, seen, optimize=True), up.sum(axis=(0, 2))


def forward(p: dict[str, np.ndarray], x: np.ndarray):
    h1, kept1 = _layer(x[:, None, :], p["k1"], p["c1"])
    h2, kept2 = _layer(h1, p["k2"], p["c2"])
    flat = h2.reshape(len(x), -1)
    hidden = np.maximum(flat @ p["w1"] + p["b1"], 0)
    logits = hidden @ p["w2"] + p["b2"]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True), (kept1, kept2, h2.shape, flat, hidden)


def gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, l2: float) -> np.ndarray:
    """Of the mean cross-entropy with an L2 term, as one vector."""
    prob, (kept1, kept2, shape, flat, hidden) = forward(p, x)
    d = (prob - np.eye(CLASSES)[y]) / len(x)
    dh = (d @ p["w2"].T) * (hidden > 0)
    d1, k2, c2 = _layer_back((dh @ p["w1"].T).reshape(shape), kept2, p["k2"])
    _, k1, c1 = _layer_back(d1, kept1, p["k1"])
    g = {"k1": k1, "c1": c1, "k2": k2, "c2": c2, "w1": flat.T @ dh, "b1": dh.sum(axis=0), "w2": hidden.T @ d, "b2": d.sum(axis=0)}
    return np.concatenate([(v + l2 * p[n] * (p[n].ndim > 1)).ravel() for n, v in g.items()])


def _clean(x) -> np.ndarray:
    return np.clip(np.nan_to_num(np.stack([np.asarray(w, float) for w in x]), nan=0.0, posinf=0.0, neginf=0.0), -CLIP, CLIP)


@dataclass
class WaveNet:
    length: int
    weights: np.ndarray | None = None  # None: not trained

    @classmethod
    def fit(
        cls, df: DataFrame, id_col: str, wave: str, label: str, length: int = 256, epochs: int = 20, batch: int = 32, rate: float = 1e-3, l2: float = 1e-4, seed: int = 42
    ) -> WaveNet:
        """df: one row per wave (array<double>) with label 0..2; fewer than six
        waves of the right length leave the network untrained."""
        rows = df.where((F.size(wave) == length) & F.col(label).between(0, CLASSES - 1)).select(F.col(id_col).alias("id"), F.col(wave).alias("x"), F.col(label).cast("int").alias("y"))
        rows = stored(rows)
        n = rows.count()
        if n < 6:
            return cls(length)
        shards = -(-n // SHARD)
        rows = stored(rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards))))
        rng = np.random.default_rng(seed)
        start = []
        for shape in shapes(length).values():
            fan = shape[0] if len(shape) == 2 else int(np.prod(shape[1:]))
            start.append((rng.standard_normal(shape) * np.sqrt((2 if len(shape) == 3 else 1) / fan)).ravel() if len(shape) > 1 else np.zeros(shape))
        w = np.concatenate(start)
        state = np.concatenate([w, np.zeros(2 * len(w))])

        for epoch in range(epochs):
            state = cls._epoch(rows, state, length, epoch, batch, rate, l2, seed)
        return cls(length, state[: len(w)])

    @staticmethod
    def _epoch(rows: DataFrame, state: np.ndarray, length: int, epoch: int, batch: int, rate: float, l2: float, seed: int) -> np.ndarray:
        size = len(state) // 3

        def shard(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("id", kind="stable")
            x, y = _clean(g["x"]), g["y"].to_numpy()
            w, m, v = (state[i * size : (i + 1) * size].copy() for i in range(3))
            order = np.random.default_rng(seed + epoch).permutation(len(y))
            steps = -(-len(y) // batch)
            for i in range(steps):
                at = order[i * batch : (i + 1) * batch]
                t = epoch * steps + i + 1
                d = gradient(_split(w, length), x[at], y[at], l2)
                m, v = 0.9 * m + 0.1 * d, 0.999 * v + 0.001 * d * d
                w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            return pd.DataFrame({"n": [len(y)], "state": [np.concatenate([w, m, v])]})

        done = rows.groupBy("shard").applyInPandas(shard, "n long, state array<double>").select("n", F.posexplode("state").alias("i", "s"))
        mean = done.groupBy("i").agg((F.sum(F.col("n") * F.col("s")) / F.sum("n")).alias("s")).toPandas()  # one row per number of the state
        return mean.sort_values("i")["s"].to_numpy()

    def probabilities(self, wave: str) -> Column:
        """array<double> of the three class probabilities."""
        length, weights = self.length, self.weights

        @F.pandas_udf("array<double>")
        def score(x: pd.Series) -> pd.Series:
            out = np.full((len(x), CLASSES), 1 / CLASSES)
            real = np.array([w is not None and len(w) == length for w in x], dtype=bool)
            if weights is not None and real.any():
                out[real] = forward(_split(weights, length), _clean(x[real]))[0]
            return pd.Series(list(out))

        return score(F.col(wave))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(self.length, None if self.weights is None else self.weights.tolist())]
        spark.createDataFrame(rows, "length int, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> WaveNet:
        r = spark.read.parquet(path).first()
        return cls(r["length"], None if r["weights"] is None else np.array(r["weights"]))
