"""Spectra of signals that no task can hold.

A discrete Fourier transform of any length n is a convolution with a chirp, which
is done by transforms of a power of two M = R x C (R >= C, M >= 2 n - 1), and those
are split: transforms of length R over the places that are equal modulo C, a turn
of every value, then transforms of length C, and the same way back. The middle
passes meet in one task, so a spectrum takes three shuffles of M numbers. A task
holds at most max(BLOCK, R) numbers, about three times the root of n, whatever
share of the rows a signal has.

Signals are (keys, pos, x) with pos from 0 on without gaps; others are numbered by
``numbered`` first. A null x counts as 0. Results are those of a direct transform
but for rounding.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import rank

#: Numbers that a task of a transform holds at once (a power of two).
BLOCK = 1 << 18


def numbered(df: DataFrame, order: str, *keys: str) -> DataFrame:
    """Adds pos: the place of a row in its signal by a number that is unique there."""
    rows = rank.cumulative(df.withColumn("_one", F.lit(1)), order, {"_at": "_one"}, keys)
    return rows.withColumn("pos", F.col("_at") - 1).drop("_one", "_at")


class Shape:
    """How the transform of n samples is split."""

    def __init__(self, n: int, block: int):
        p = (2 * n - 2).bit_length()
        self.n, self.m, self.c = n, 1 << p, 1 << p // 2
        self.r = self.m // self.c
        self.b = max(1, min(self.c, block // self.r))

    def chirp(self, j: np.ndarray) -> np.ndarray:
        return np.exp(-1j * np.pi * (j * j % (2 * self.n)) / self.n)

    def turn(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.exp(-2j * np.pi * (i[:, None] * j[None, :] % self.m) / self.m)

    def block(self, number: int) -> np.ndarray:
        return number * self.b + np.arange(self.b)


def _first_block(n: Column, pos: Column) -> Column:
    """The block of pos modulo C, by the numbers of Shape."""
    p = F.when(n > 1, F.length(F.bin(2 * n - 2))).otherwise(0)
    c = F.pow(F.lit(2), F.floor(p / 2)).cast("long")
    r = F.pow(F.lit(2), p - F.floor(p / 2)).cast("long")
    b = F.greatest(F.lit(1), F.least(c, F.floor(F.lit(BLOCK) / r)))
    return F.floor(pos % c / b)


def _tiles(key: tuple, n: int, values: np.ndarray, b: int) -> pd.DataFrame:
    """Cuts (..., rows, b) into tiles of b x b for the tasks of the next pass."""
    rows = values.shape[-2] // b
    tiles = [np.ascontiguousarray(values[..., i * b : (i + 1) * b, :]).tobytes() for i in range(rows)]
    head = {f"k{i}": [k] * rows for i, k in enumerate(key[:-1])}
    return pd.DataFrame({**head, "n": n, "to": range(rows), "of": int(key[-1]), "v": tiles})


def _untiled(g: pd.DataFrame, lead: tuple[int, ...], b: int) -> np.ndarray:
    """The tiles that came from all tasks of the pass before, side by side in the
    order of their places: (*lead, b, all places). Each tile is (*lead, b, b)."""
    tiles = [np.frombuffer(v, complex).reshape(*lead, b, b) for v in g.sort_values("of")["v"]]
    return np.concatenate(tiles, axis=-1)


def _columns(key: tuple, g: pd.DataFrame, block: int) -> pd.DataFrame:
    """Transforms of length R of the turned signal and of the chirp."""
    s = Shape(int(g["n"].iloc[0]), block)
    own = s.block(int(key[-1]))
    pos = g["pos"].to_numpy(np.int64)
    pair = np.zeros((2, s.r, s.b), complex)
    pair[0, pos // s.c, pos % s.c - own[0]] = g["x"].to_numpy(float) * s.chirp(pos)
    j = s.c * np.arange(s.r)[:, None] + own[None, :]
    back = np.minimum(j, s.m - j)  # the chirp lies around 0 in a circle of M
    pair[1] = np.where(back < s.n, np.conj(s.chirp(np.where(back < s.n, back, 0))), 0)
    return _tiles(key, s.n, np.fft.fft(pair, axis=1) * s.turn(np.arange(s.r), own), s.b)


def _middle(key: tuple, g: pd.DataFrame, block: int) -> pd.DataFrame:
    """Transforms of length C, the product, and their way back."""
    s = Shape(int(g["n"].iloc[0]), block)
    own = s.block(int(key[-1]))
    signal, chirp = np.fft.fft(_untiled(g, (2,), s.b), axis=-1)
    back = np.fft.ifft(signal * chirp, axis=-1) * np.conj(s.turn(own, np.arange(s.c)))
    return _tiles(key, s.n, back.T, s.b)


def _rows(key: tuple, g: pd.DataFrame, block: int) -> pd.DataFrame:
    """The last transforms of length R: the spectrum at the places of a block."""
    s = Shape(int(g["n"].iloc[0]), block)
    conv = np.fft.ifft(_untiled(g, (), s.b), axis=-1)
    k = s.block(int(key[-1]))[:, None] + s.c * np.arange(s.r)[None, :]
    keep = k <= s.n // 2
    k, y = k[keep], conv[keep]
    y = y * s.chirp(k)
    head = {f"k{i}": [v] * len(k) for i, v in enumerate(key[:-1])}
    return pd.DataFrame({**head, "n": s.n, "k": k, "re": y.real, "im": y.imag})


def spectrum(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, k, re, im) for k = 0 .. n // 2 of every signal (keys, pos, x):
    the sum of x times exp(-2 pi i k pos / n)."""
    size = df.groupBy(*keys).agg(F.count("*").alias("n"))
    rows = rank.beside(df.select(*keys, "pos", F.coalesce("x", F.lit(0.0)).cast("double").alias("x")), size, list(keys))
    named = [F.col(c).alias(f"k{i}") for i, c in enumerate(keys)]
    types = dict(rows.dtypes)
    head = "".join(f"k{i} {types[c]}, " for i, c in enumerate(keys))
    own = [f"k{i}" for i in range(len(keys))]
    tiles = head + "n long, to long, of long, v binary"
    rows = rows.select(*named, "n", "pos", "x", _first_block(F.col("n"), F.col("pos")).alias("to"))
    block = BLOCK
    first = rows.groupBy(*own, "to").applyInPandas(lambda key, g: _columns(key, g, block), tiles)
    second = first.groupBy(*own, "to").applyInPandas(lambda key, g: _middle(key, g, block), tiles)
    out = second.groupBy(*own, "to").applyInPandas(lambda key, g: _rows(key, g, block), head + "n long, k long, re double, im double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], "n", "k", "re", "im")


#: Least change of the peak frequency a second that counts as a drift.
LEAST_DRIFT = 0.5


def numbers(df: DataFrame, *columns: str, fs: float = 1000.0) -> DataFrame:
    """(signal_id, columns) of fft_freq, fft_mag, drift_rate and harmonics for
    signals (signal_id, pos, x) of 64 samples or more: peaks of the whole signal
    (part 0) and, for the drift, of its quarters (1 to 4)."""
    size = stored(df.groupBy("signal_id").agg(F.count("*").alias("size")))
    step = 1.0 / (F.col("n") * (1 / fs))  # of frequencies; borders are met as by NumPy
    quarter = F.floor(F.col("size") / 4)
    whole = F.struct(F.lit(0).alias("part"), F.col("pos").cast("long").alias("pos"))
    part = F.struct((F.floor(F.col("pos") / quarter) + 1).cast("int").alias("part"), (F.col("pos") % quarter).cast("long").alias("pos"))
    used = [whole] * (set(columns) != {"drift_rate"}) + [part] * ("drift_rate" in columns)
    rows = rank.beside(df, size, ["signal_id"]).select("signal_id", F.explode(F.array(*used)).alias("at"), "x")
    lines = spectrum(rows.select("signal_id", "at.*", "x").where("part < 5"), "signal_id", "part")
    lines = stored(lines.where("k > 0").select("signal_id", "part", "n", "k", (F.col("re") ** 2 + F.col("im") ** 2).alias("power")))
    top = F.max(F.struct("power", (-F.col("k")).alias("k"), "n")).alias("t")
    peaks = lines.groupBy("signal_id", "part").agg(top).select("signal_id", "part", "t.n", (-F.col("t.k")).alias("peak"), F.col("t.power").alias("most"))
    peaks = stored(peaks.withColumn("freq", F.col("peak") * step))
    one = peaks.where("part = 0")
    out = size
    if {"fft_freq", "fft_mag"} & set(columns):
        out = out.join(one.select("signal_id", F.col("freq").alias("fft_freq"), F.sqrt("most").alias("fft_mag")), "signal_id", "left")
    if "drift_rate" in columns:
        rows = peaks.where("part > 0").withColumn("mid", (F.col("part") - 0.5) * F.col("n") / fs)
        slope = rows.groupBy("signal_id").agg(F.regr_slope("freq", "mid").alias("s"))
        out = out.join(slope.select("signal_id", F.when(F.abs("s") >= LEAST_DRIFT, F.col("s")).otherwise(0.0).alias("drift_rate")), "signal_id", "left")
    if "harmonics" in columns:
        near = rank.beside(lines.where("part = 0").drop("part", "n"), one.select("signal_id", "n", "peak", "most", "freq"), ["signal_id"])
        f, tol = F.col("k") * step, F.greatest(1.5 * step, F.lit(2.0))
        around = [F.max(F.when(F.abs(f - m * F.col("freq")) <= tol, F.col("power"))).alias(f"h{m}") for m in range(2, 6)]
        sums = near.groupBy("signal_id").agg(F.first("most").alias("most"), F.first("freq").alias("freq"), *around)
        heard = [F.when(m * F.col("freq") <= fs / 2, F.coalesce(F.col(f"h{m}"), F.lit(0.0)) / F.col("most")) for m in range(2, 6)]
        mean = F.aggregate(F.array_compact(F.array(*heard)), F.lit(0.0), lambda a, v: a + v) / F.size(F.array_compact(F.array(*heard)))
        share = F.when((F.col("most") > 0) & (2 * F.col("freq") <= fs / 2), mean).otherwise(0.0)
        out = out.join(sums.select("signal_id", share.alias("harmonics")), "signal_id", "left")
    return out.select("signal_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


#: Samples of a piece of a signal that is written as letters.
PIECE = 4096


def letters(df: DataFrame) -> DataFrame:
    """(signal_id, piece, s): each signal cut at its exact median, one letter a
    sample (1 above the median), in pieces."""
    df = stored(df)
    median = rank.quantiles(df, ("x",), (0.5,), ("signal_id",)).select("signal_id", F.col("q0").alias("median"))
    rows = rank.beside(df, stored(median), ["signal_id"])
    bit = F.struct("pos", F.when(F.col("x") > F.col("median"), "1").otherwise("0").alias("c"))
    line = F.concat_ws("", F.transform(F.array_sort(F.collect_list(bit)), lambda v: v["c"]))
    return rows.groupBy("signal_id", F.floor(F.col("pos") / PIECE).alias("piece")).agg(line.alias("s"))
