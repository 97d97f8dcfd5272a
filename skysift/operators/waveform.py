"""One-dimensional signals: long form (signal_id, pos, x) for the relational
operators, one Arrow group per signal for the sequential and spectral ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..session import stored
from . import longwave, rank


def _by_pos() -> WindowSpec:
    return W.partitionBy("signal_id").orderBy("pos")


def shannon_entropy(df: DataFrame, bins: int = 128) -> DataFrame:
    """(signal_id, entropy) over equal-width bins, relative to log2(bins)."""
    ends = df.groupBy("signal_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    b = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    c = df.join(ends.where("hi > lo"), "signal_id").groupBy("signal_id", b.alias("b")).agg((F.count("*") / F.first("n")).alias("p"))
    h = c.groupBy("signal_id").agg((-F.sum(F.col("p") * F.log2("p")) / math.log2(bins)).alias("h"))
    return ends.join(h, "signal_id", "left").select("signal_id", F.coalesce(F.least(F.greatest("h", F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("entropy"))


def permutation_entropy(df: DataFrame) -> DataFrame:
    """(signal_id, permutation_entropy) of order 3, delay 1; equal samples keep
    their order."""
    a, b, c = F.col("x"), F.lead("x", 1).over(_by_pos()), F.lead("x", 2).over(_by_pos())
    rows = df.select("signal_id", a.alias("a"), b.alias("b"), c.alias("c"))
    pattern = F.concat((F.col("a") <= F.col("b")).cast("int"), (F.col("b") <= F.col("c")).cast("int"), (F.col("a") <= F.col("c")).cast("int"))
    counts = rows.where("c IS NOT NULL").groupBy("signal_id", pattern.alias("k")).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(W.partitionBy("signal_id"))
    h = counts.withColumn("p", p).groupBy("signal_id").agg((-F.sum(F.col("p") * F.log2("p")) / math.log2(6)).alias("h"))
    return df.select("signal_id").distinct().join(h, "signal_id", "left").select("signal_id", F.least(F.coalesce("h", F.lit(0.0)), F.lit(1.0)).alias("permutation_entropy"))


def higuchi_dimension(df: DataFrame, k_max: int = 10) -> DataFrame:
    """(signal_id, fractal_dimension): slope of log curve length on log 1/k,
    kept to [1, 2]; 1.5 under 20 samples."""
    n = F.count("*").over(W.partitionBy("signal_id"))
    steps = [F.struct(F.lit(k).alias("k"), F.abs(F.lead("x", k).over(_by_pos()) - F.col("x")).alias("d")) for k in range(1, k_max + 1)]
    rows = df.select("signal_id", "pos", n.alias("n"), F.array(*steps).alias("_s")).select("signal_id", "pos", "n", F.explode_outer("_s").alias("s")).select("signal_id", "pos", "n", "s.k", "s.d")
    per = rows.where("d IS NOT NULL").groupBy("signal_id", "n", "k", (F.col("pos") % F.col("k")).alias("m")).agg(F.sum("d").alias("d"))
    whole = F.floor((F.col("n") - F.col("m") - 1) / F.col("k"))
    length = F.col("d") * (F.col("n") - 1) / (whole * F.col("k")) / F.col("k")
    curve = per.where(whole > 0).groupBy("signal_id", "n", "k").agg(F.avg(length).alias("l")).where("l > 0")
    fit = curve.groupBy("signal_id", "n").agg(F.regr_slope(F.log("l"), -F.log(F.col("k").cast("double"))).alias("s"))
    size = df.groupBy("signal_id").agg(F.count("*").alias("n"))
    d = F.when((F.col("n") < 20) | F.col("s").isNull(), 1.5).otherwise(F.least(F.greatest("s", F.lit(1.0)), F.lit(2.0)))
    return size.join(fit.drop("n"), "signal_id", "left").select("signal_id", d.alias("fractal_dimension"))


def intensity_sigma(df: DataFrame) -> DataFrame:
    """(signal_id, intensity_sigma): largest deviation in population spreads."""
    a = df.groupBy("signal_id").agg(F.max("x").alias("hi"), F.min("x").alias("lo"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return a.select("signal_id", (F.greatest(F.col("hi") - F.col("m"), F.col("m") - F.col("lo")) / (F.col("s") + 1e-12)).alias("intensity_sigma"))


def delay_embedding(df: DataFrame, dim: int = 5, delay: int = 2) -> DataFrame:
    """(signal_id, pos, e0 .. e<dim - 1>): delay vectors that fit."""
    cols = [F.lead("x", i * delay).over(_by_pos()).alias(f"e{i}") for i in range(dim)]
    return df.select("signal_id", "pos", *cols).where(F.col(f"e{dim - 1}").isNotNull())


# one signal in an array, in NumPy


def lz76(x: np.ndarray) -> float:
    """Lempel-Ziv (1976) phrases of the signal cut at its median, relative to
    n / (log2 n + 1)."""
    return phrase_rate("".join("1" if v else "0" for v in x > np.median(x))) if len(x) > 1 else 0.0


def phrase_rate(s: str) -> float:
    """Lempel-Ziv (1976) phrases of a string, relative to n / (log2 n + 1)."""
    n = len(s)
    if n < 2:
        return 0.0
    phrases, at = 0, 0
    while at < n:
        size, found = 1, 0
        # a phrase grows while it can be copied from what precedes its end; a
        # longer one is not found before the place of a shorter one
        while at + size <= n and (found := s.find(s[at : at + size], found, at + size - 1)) >= 0:
            size += 1
        phrases += 1
        at += size
    return float(min(max(phrases / (n / (math.log2(n) + 1)), 0.0), 1.0))


def fft_peak(x: np.ndarray, fs: float = 1000.0) -> tuple[float, float]:
    """(frequency, magnitude) of the largest component but the constant one."""
    m = np.abs(np.fft.rfft(x))
    if len(m) < 2:
        return 0.0, 0.0
    m[0] = 0
    k = int(np.argmax(m))
    return float(np.fft.rfftfreq(len(x), 1 / fs)[k]), float(m[k])


def spectral_drift(x: np.ndarray, fs: float = 1000.0) -> float:
    """Slope of the peak frequency over four parts; small ones are 0."""
    if len(x) < 64:
        return 0.0
    size = len(x) // 4
    peaks = [fft_peak(x[i * size : (i + 1) * size], fs)[0] for i in range(4)]
    mid = (np.arange(4) + 0.5) * size / fs
    slope = float(np.polyfit(mid, peaks, 1)[0])
    return slope if abs(slope) >= 0.5 else 0.0


def harmonic_complexity(x: np.ndarray, fs: float = 1000.0) -> float:
    """Mean power at twice to five times the peak, relative to the peak's."""
    power = np.abs(np.fft.rfft(x)) ** 2
    f = np.fft.rfftfreq(len(x), 1 / fs) if len(x) else np.zeros(0)
    if len(power) < 3:
        return 0.0
    power[0] = 0
    k = int(np.argmax(power))
    if power[k] <= 0:
        return 0.0
    tol = max(1.5 * (f[1] - f[0]), 2.0)
    shares = []
    for m in range(2, 6):
        if m * f[k] <= fs / 2:
            near = np.abs(f - m * f[k]) <= tol
            shares.append(float(power[near].max() / power[k]) if near.any() else 0.0)
    return float(np.mean(shares)) if shares else 0.0


#: Distances that a block of delay vectors may hold at once.
BLOCK = 2_000_000
FS, DIM, DELAY, THEILER, STEPS = 1000.0, 5, 2, 10, 8


def divergence(x: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """By step, the sum and number of the log distances to which delay vectors
    start .. stop - 1 part from their nearest neighbours (THEILER samples apart);
    memory is that of (stop - start) x n distances."""
    x = x - np.mean(x)
    n = len(x) - (DIM - 1) * DELAY
    y = np.stack([x[i * DELAY : i * DELAY + n] for i in range(DIM)], axis=1)
    sq = (y * y).sum(axis=1)
    i, j = np.arange(start, min(stop, n)), np.arange(n)
    d = np.sqrt(np.maximum(sq[i, None] + sq[None, :] - 2 * y[i] @ y.T, 0))
    d[np.abs(i[:, None] - j[None, :]) < THEILER] = np.inf
    near = d.argmin(axis=1)
    total, count = np.zeros(STEPS + 1), np.zeros(STEPS + 1, dtype=int)
    far = np.isfinite(d[np.arange(len(i)), near])
    for s in range(min(STEPS, n - 1) + 1):
        ok = (i + s < n) & (near + s < n) & far
        gap = np.linalg.norm(y[i[ok] + s] - y[near[ok] + s], axis=1)
        gap = gap[gap > 0]
        total[s], count[s] = np.log(gap).sum(), len(gap)
    return total, count


def divergences(x: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """divergence of many signals of one length at once (a row each); memory is
    that of rows x (stop - start) x n distances."""
    x = x - x.mean(axis=1, keepdims=True)
    n = x.shape[1] - (DIM - 1) * DELAY
    y = np.stack([x[:, i * DELAY : i * DELAY + n] for i in range(DIM)], axis=2)
    sq = (y * y).sum(axis=2)
    i, j = np.arange(start, min(stop, n)), np.arange(n)
    d = np.sqrt(np.maximum(sq[:, i, None] + sq[:, None, :] - 2 * y[:, i] @ y.transpose(0, 2, 1), 0))
    d[:, np.abs(i[:, None] - j[None, :]) < THEILER] = np.inf
    near, row = d.argmin(axis=2), np.arange(len(x))[:, None]
    far = np.isfinite(np.take_along_axis(d, near[:, :, None], 2)[:, :, 0])
    total, count = np.zeros((len(x), STEPS + 1)), np.zeros((len(x), STEPS + 1), dtype=int)
    for s in range(min(STEPS, n - 1) + 1):
        ok = (i + s < n) & (near + s < n) & far
        gap = np.linalg.norm(y[:, np.minimum(i + s, n - 1)] - y[row, np.minimum(near + s, n - 1)], axis=2)
        ok &= gap > 0
        total[:, s], count[:, s] = np.log(gap, where=ok, out=np.zeros_like(gap)).sum(axis=1), ok.sum(axis=1)
    return total, count


def aaft(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Amplitude-adjusted surrogate (textbook rank map): Gaussian data in the
    signal's order, phases randomised, then the signal's values by rank."""
    n = len(x)
    g = np.sort(rng.standard_normal(n))[np.argsort(np.argsort(x))]
    f = np.fft.rfft(g)
    f[1:] *= np.exp(2j * np.pi * rng.random(len(f) - 1))
    return np.sort(x)[np.argsort(np.argsort(np.fft.irfft(f, n)))]


def surrogate(x: np.ndarray, which: int, seed: int = 42) -> np.ndarray:
    """The signal itself (0) or one of its surrogates, the same in every task."""
    return aaft(x, np.random.default_rng([seed, which])) if which else x


def exponents(df: DataFrame, n_surrogates: int = 0) -> DataFrame:
    """(signal_id, which, lyapunov) of every signal (which = 0) and its
    surrogates: the slope of the mean log divergence of nearest neighbours. Tasks
    are dealt by (signal, block of delay vectors), and of long signals by surrogate,
    so that such a signal needs memory for its samples and one block only. Short
    signals go through with all their surrogates at once."""
    series = df.groupBy("signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda v: v["x"]).alias("x"))
    n = F.size("x") - (DIM - 1) * DELAY
    rows = series.where(n >= 20).withColumn("size", F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / n)).cast("int"))
    rows = rows.select("signal_id", "x", "size", F.explode(F.sequence(F.lit(0), n - 1, F.col("size"))).alias("start"))
    every = F.sequence(F.lit(0), F.lit(n_surrogates))
    # as many surrogates a row as have their distances within a block
    at_once = F.greatest(F.lit(1), F.floor(F.lit(BLOCK) / (F.least("size", n) * n))).cast("int")
    rows = rows.withColumn("which", F.explode(F.sequence(F.lit(0), F.lit(n_surrogates), at_once))).withColumn("many", at_once)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, x, size, start, lo, many in zip(batch["signal_id"], batch["x"], batch["size"], batch["start"], batch["which"], batch["many"], strict=True):
                x = np.asarray(x, float)
                if np.std(x) >= 1e-12:
                    which = np.arange(lo, min(lo + many, n_surrogates + 1))
                    total, count = divergences(np.stack([surrogate(x, int(w)) for w in which]), int(start), int(start) + int(size))
                    k, s = np.nonzero(count)
                    out.append((np.full(len(k), key), which[k], s / FS, total[k, s], count[k, s]))
            if out:
                yield pd.DataFrame(dict(zip(["signal_id", "which", "t", "total", "n"], map(np.concatenate, zip(*out, strict=True)), strict=True)))

    dealt = rows.repartition(parts, "signal_id", "which", "start")
    curve = dealt.mapInPandas(run, "signal_id long, which int, t double, total double, n long").groupBy("signal_id", "which", "t").agg((F.sum("total") / F.sum("n")).alias("y"))
    slope = curve.groupBy("signal_id", "which").agg(F.regr_slope("y", "t").alias("slope"))
    each = df.select("signal_id").distinct().withColumn("which", F.explode(every))
    return each.join(slope, ["signal_id", "which"], "left").select("signal_id", "which", F.coalesce("slope", F.lit(0.0)).alias("lyapunov"))


def chaos(df: DataFrame, n_surrogates: int = 19) -> DataFrame:
    """(signal_id, lyapunov, chaos_p): the exponent and the share of surrogates
    whose exponent is at least as large."""
    each = exponents(df, n_surrogates)
    real = each.where("which = 0").select("signal_id", "lyapunov")
    other = each.where("which > 0").select("signal_id", F.col("lyapunov").alias("o"))
    return real.join(other, "signal_id").groupBy("signal_id").agg(F.first("lyapunov").alias("lyapunov"), F.avg((F.col("o") >= F.col("lyapunov")).cast("double")).alias("chaos_p"))


#: What can be read off a whole signal in O(n) memory.
SPECTRAL = {
    "lz76": lz76, "fft_freq": lambda x: fft_peak(x)[0], "fft_mag": lambda x: fft_peak(x)[1],
    "drift_rate": spectral_drift, "harmonics": harmonic_complexity,
}


#: Samples of a signal up to which one task reads it whole.
LONG = 1 << 20


def spectra(df: DataFrame, *columns: str) -> DataFrame:
    """(signal_id, columns) of SPECTRAL. Signals of up to LONG samples are an Arrow
    group each, in which nothing but the columns asked for is computed. Spectra of
    longer ones are split over tasks (longwave), and their phrases are counted on
    one letter a sample."""
    size = stored(df.groupBy("signal_id").agg(F.count("*").alias("_n")))
    if not size.where(F.col("_n") > LONG).limit(1).count():
        return _spectra_whole(df, columns)
    rows = stored(rank.beside(df, size, ["signal_id"]))
    out = _spectra_whole(rows.where(F.col("_n") <= LONG).drop("_n"), columns)
    long = longwave.numbered(rows.where(F.col("_n") > LONG).drop("_n"), "pos", "signal_id")
    long = stored(long.select("signal_id", "pos", "x"))
    split = [c for c in columns if c != "lz76"]
    more = longwave.numbers(long, *split) if split else long.select("signal_id").distinct()
    if "lz76" in columns:
        more = more.join(_phrases(longwave.letters(long)), "signal_id")
    return out.unionByName(more.select(*out.columns))


def _spectra_whole(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("pos")["x"].to_numpy(float)
        return pd.DataFrame({"signal_id": [g["signal_id"].iloc[0]], **{c: [SPECTRAL[c](x)] for c in columns}})

    return df.groupBy("signal_id").applyInPandas(run, "signal_id long" + "".join(f", {c} double" for c in columns))


def _phrases(pieces: DataFrame) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        s = "".join(g.sort_values("piece")["s"])
        return pd.DataFrame({"signal_id": [g["signal_id"].iloc[0]], "lz76": [phrase_rate(s)]})

    return pieces.groupBy("signal_id").applyInPandas(run, "signal_id long, lz76 double")


def spectral_features(df: DataFrame) -> DataFrame:
    """(signal_id, the SPECTRAL columns, lyapunov, chaos_p)."""
    return spectra(df, *SPECTRAL).join(chaos(df), "signal_id")
