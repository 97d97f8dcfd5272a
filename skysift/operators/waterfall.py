"""Dynamic spectra in long form: one row per observation, time and channel.

Input columns: obs_id, t, ch, freq_mhz, power. Orientation and unit mistakes
cannot occur: time and channel are named and frequencies are in MHz. All
operators shuffle by observation (and channel or time), so observations spread
over the cluster.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

#: Dispersion constant, MHz^2 s per unit of dispersion measure.
K_DM = 4148.808
MAD_SCALE = 1.4826


def repair(df: DataFrame) -> DataFrame:
    """Replaces samples that are missing or not finite by their channel's
    median of the finite ones (0 without any)."""
    bad = F.col("power").isNull() | F.isnan("power") | F.col("power").isin(float("inf"), float("-inf"))
    good = F.when(~bad, F.col("power"))
    med = df.groupBy("obs_id", "ch").agg(F.median(good).alias("_m"))
    return df.join(med, ["obs_id", "ch"]).withColumn("power", F.coalesce(good, F.col("_m"), F.lit(0.0))).drop("_m")


def channel_stats(df: DataFrame) -> DataFrame:
    """(obs_id, ch, med, mad) of each channel."""
    med = df.groupBy("obs_id", "ch").agg(F.median("power").alias("med"))
    return df.join(med, ["obs_id", "ch"]).groupBy("obs_id", "ch").agg(F.first("med").alias("med"), F.median(F.abs(F.col("power") - F.col("med"))).alias("mad"))


def normalize_bandpass(df: DataFrame) -> DataFrame:
    """Adds norm: the robust z-score within the channel; a channel without
    variance is 0."""
    flat = df.groupBy("obs_id", "ch").agg((F.max("power") == F.min("power")).alias("_flat"))
    s = channel_stats(df).join(flat, ["obs_id", "ch"])
    z = (F.col("power") - F.col("med")) / (MAD_SCALE * (F.col("mad") + 1e-12))
    return df.join(s, ["obs_id", "ch"]).withColumn("norm", F.when(F.col("_flat"), 0.0).otherwise(z)).drop("med", "mad", "_flat")


def delays(df: DataFrame, dm: Column, t_samp: float) -> DataFrame:
    """Adds shift: whole samples by which a channel lags the highest one."""
    top = df.groupBy("obs_id").agg(F.max("freq_mhz").alias("_top"))
    lag = K_DM * dm * (1 / (F.col("freq_mhz") * F.col("freq_mhz")) - 1 / (F.col("_top") * F.col("_top"))) / t_samp
    return df.join(top, "obs_id").withColumn("shift", F.rint(lag).cast("int")).drop("_top")


def dedisperse(df: DataFrame, t_samp: float, dm_max: float, n_dm: int, value: str = "power") -> DataFrame:
    """(obs_id, dm_idx, dm, t, profile) for a linear grid of trial measures;
    trials whose largest lag leaves the data are left out."""
    step = dm_max / (n_dm - 1)
    n_time = df.groupBy("obs_id").agg((F.max("t") + 1).alias("_n"))
    # the lag is linear in the measure, so it is worked out once a channel
    chan = df.select("obs_id", "ch", "freq_mhz").distinct()
    grid = chan.withColumn("dm_idx", F.explode(F.sequence(F.lit(0), F.lit(n_dm - 1)))).withColumn("dm", F.col("dm_idx") * step)
    grid = delays(grid, F.col("dm"), t_samp).join(n_time, "obs_id")
    fits = grid.groupBy("obs_id", "dm_idx").agg((F.max("shift") < F.first("_n")).alias("_ok"))
    grid = grid.join(fits, ["obs_id", "dm_idx"]).where("_ok").select("obs_id", "ch", "dm_idx", "dm", "shift")
    moved = df.join(grid, ["obs_id", "ch"]).withColumn("t", F.col("t") - F.col("shift")).where("t >= 0")
    return moved.groupBy("obs_id", "dm_idx", "dm", "t").agg(F.sum(value).alias("profile"))


def dm_sweep(df: DataFrame, t_samp: float, dm_max: float, n_dm: int, value: str = "power") -> DataFrame:
    """(obs_id, dm_idx, dm, snr): the peak of each trial's profile over its
    spread."""
    prof = dedisperse(df, t_samp, dm_max, n_dm, value)
    s = prof.groupBy("obs_id", "dm_idx", "dm").agg(
        F.median("profile").alias("_m"), F.stddev_pop("profile").alias("_s"), F.max("profile").alias("_hi"), F.min("profile").alias("_lo")
    )
    peak = F.greatest(F.col("_hi") - F.col("_m"), F.col("_m") - F.col("_lo"))
    return s.select("obs_id", "dm_idx", "dm", F.when(F.col("_s") > 0, peak / F.col("_s")).otherwise(0.0).alias("snr"))


def dm_best(sweep: DataFrame) -> DataFrame:
    """(obs_id, best_dm, best_snr, dm0_snr, dm0_peak_ratio, dm_curve_sharpness);
    of equal peaks the smallest measure."""
    rows = sweep.withColumn("snr", F.round("snr", 6))
    a = rows.groupBy("obs_id").agg(
        F.max(F.struct(F.col("snr"), (-F.col("dm_idx")).alias("i"), F.col("dm"))).alias("b"), F.avg("snr").alias("mean"),
        F.max(F.when(F.col("dm_idx") == 0, F.col("snr"))).alias("dm0_snr"),
    )
    sharp = F.least(F.greatest(F.col("b.snr") / F.nullif("mean", F.lit(0.0)) - 1, F.lit(0.0)), F.lit(10.0))
    return a.select(
        "obs_id", F.col("b.dm").alias("best_dm"), F.col("b.snr").alias("best_snr"), "dm0_snr",
        (F.col("dm0_snr") / (F.col("b.snr") + 1e-12)).alias("dm0_peak_ratio"), F.coalesce(sharp, F.lit(0.0)).alias("dm_curve_sharpness"),
    )


def channel_power(df: DataFrame) -> DataFrame:
    """(obs_id, ch, ch_power): mean square around the channel's median."""
    s = channel_stats(df).select("obs_id", "ch", "med")
    d = F.col("power") - F.col("med")
    return df.join(s, ["obs_id", "ch"]).groupBy("obs_id", "ch").agg(F.avg(d * d).alias("ch_power"))


def _med_mad(df: DataFrame, value: str) -> DataFrame:
    med = df.groupBy("obs_id").agg(F.median(value).alias("_med"))
    mad = df.join(med, "obs_id").groupBy("obs_id").agg(F.first("_med").alias("_med"), F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    return df.join(mad, "obs_id")


def band_shape(power: DataFrame) -> DataFrame:
    """(obs_id, narrowband_fraction, peak_channel_snr, band_skewness,
    band_kurtosis) of the channel powers."""
    rows = _med_mad(power, "ch_power")
    mad = F.col("_mad") + 1e-9
    return rows.groupBy("obs_id").agg(
        F.avg((F.col("ch_power") > F.col("_med") + 8 * mad).cast("double")).alias("narrowband_fraction"),
        (F.max("ch_power") / (F.first(mad) + 1e-12)).alias("peak_channel_snr"),
        F.coalesce(F.skewness("ch_power"), F.lit(0.0)).alias("band_skewness"),
        F.coalesce(F.kurtosis("ch_power"), F.lit(0.0)).alias("band_kurtosis"),
    )


def spectral_kurtosis(power: DataFrame, seg: int = 64) -> DataFrame:
    """(obs_id, sk): log of the kurtosis estimate over segments of seg channels
    (halves of a narrower band) from their mean squares; the floor is -30. What
    is left over at the end of the band is left out."""
    n = power.groupBy("obs_id").agg(F.count("*").alias("n"), F.var_pop("ch_power").alias("v"), F.avg("ch_power").alias("m"))
    size = F.when(F.col("n") < 2 * seg, F.greatest(F.lit(1), F.floor(F.col("n") / 2))).otherwise(seg)
    n = n.withColumn("size", size).withColumn("k", F.floor(F.col("n") / F.col("size")))
    rows = power.join(n, "obs_id").withColumn("seg", F.floor(F.col("ch") / F.col("size"))).where("seg < k")
    squares = rows.groupBy("obs_id", "seg").agg(F.avg(F.col("ch_power") * F.col("ch_power")).alias("p"), *[F.first(c).alias(c) for c in "kvm"])
    one = squares.groupBy("obs_id").agg(F.var_pop("p").alias("vp"), F.avg("p").alias("mp"), *[F.first(c).alias(c) for c in "kvm"])
    sk = F.col("k") / (F.col("k") - 1) * F.col("vp") / (F.col("mp") * F.col("mp") + 1e-12) - 1
    alone = F.log(F.col("v") / (F.col("m") * F.col("m") + 1e-12) + 1e-12)
    return one.select("obs_id", F.when(F.col("k") < 2, alone).when(sk <= -1e-12, -30.0).otherwise(F.log(sk + 1e-12)).alias("sk"))


def occupancy(norm: DataFrame) -> DataFrame:
    """(obs_id, occupancy): share of samples beyond five spreads."""
    sd = norm.groupBy("obs_id").agg(F.stddev_pop("norm").alias("_sd"))
    return norm.join(sd, "obs_id").groupBy("obs_id").agg(F.avg((F.abs("norm") > 5 * F.col("_sd")).cast("double")).alias("occupancy"))


def tone_persistence(df: DataFrame, power: DataFrame) -> DataFrame:
    """(obs_id, peak_ch, tone_persistence): share of the strongest channel's
    samples at five robust deviations or more (the lowest of equal channels).
    The deviation is one for the whole observation, of all samples less their
    channel's median."""
    best = power.withColumn("ch_power", F.round("ch_power", 6)).groupBy("obs_id").agg(F.max(F.struct("ch_power", (-F.col("ch")).alias("i"))).alias("b"))
    peak = best.select("obs_id", (-F.col("b.i")).alias("ch"))
    med = df.groupBy("obs_id", "ch").agg(F.median("power").alias("_m"))
    rows = df.join(med, ["obs_id", "ch"]).withColumn("bp", F.col("power") - F.col("_m"))
    centre = rows.groupBy("obs_id").agg(F.median("bp").alias("_c"))
    noise = rows.join(centre, "obs_id").groupBy("obs_id").agg((F.median(F.abs(F.col("bp") - F.col("_c"))) + 1e-9).alias("_n"))
    z = F.col("bp") / (MAD_SCALE * F.col("_n"))
    lines = rows.join(peak, ["obs_id", "ch"]).join(noise, "obs_id")
    return lines.groupBy("obs_id").agg(F.first("ch").alias("peak_ch"), F.avg((z >= 5).cast("double")).alias("tone_persistence"))


def channel_means(df: DataFrame) -> DataFrame:
    return df.groupBy("obs_id", "ch").agg(F.avg("power").alias("m"))


def background(means: DataFrame) -> DataFrame:
    """(obs_id, bg_med, bg_noise): robust background of the channel means."""
    return _med_mad(means, "m").groupBy("obs_id").agg(F.first("_med").alias("bg_med"), (MAD_SCALE * (F.first("_mad") + 1e-9)).alias("bg_noise"))


def gini(df: DataFrame, value: str = "m") -> DataFrame:
    """(obs_id, concentration): Gini coefficient of the values of 0 or more.
    Rows are ranked within observation; equal values may take any order."""
    w = W.partitionBy("obs_id").orderBy(value)
    rows = df.where(F.col(value) >= 0).withColumn("_i", F.row_number().over(w))
    a = rows.groupBy("obs_id").agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col("_i") * F.col(value)).alias("iv"))
    g = (2 * F.col("iv") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s") + 1e-12)
    found = a.select("obs_id", F.when(F.col("s") > 0, F.least(F.greatest(g, F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("concentration"))
    return df.select("obs_id").distinct().join(found, "obs_id", "left").na.fill(0.0, ["concentration"])


def drift_rate(df: DataFrame, bg: DataFrame) -> DataFrame:
    """(obs_id, drift_rate): slope over time of the mean channel, weighted by
    the power above the background (the strongest channel where there is none)."""
    w = F.greatest(F.col("power") - F.col("bg_med"), F.lit(0.0))
    c = df.join(bg.select("obs_id", "bg_med"), "obs_id").groupBy("obs_id", "t").agg(
        F.sum(w).alias("s"), F.sum(F.col("ch") * w).alias("c"), F.max(F.struct("power", (-F.col("ch")).alias("i")))["i"].alias("i")
    )
    c = c.withColumn("centre", F.when(F.col("s") > 0, F.col("c") / F.col("s")).otherwise(-F.col("i")))
    return c.groupBy("obs_id").agg(F.coalesce(F.regr_slope("centre", "t"), F.lit(0.0)).alias("drift_rate"))


def descriptors(df: DataFrame) -> DataFrame:
    """The ten descriptors of each observation: of its channel means, but for
    the drift and the kurtosis of the brightest time."""
    rows = stored(df.select("obs_id", "t", "ch", "power"))
    means = stored(channel_means(rows))
    bg = stored(background(means))
    noise = F.greatest(1.5 * MAD_SCALE * F.col("bg_noise"), F.lit(1e-9))
    lines = means.join(bg.select("obs_id", "bg_med", noise.alias("noise")), "obs_id")
    m, med, n = F.col("m"), F.first("bg_med"), F.count("*")
    hit = m > F.col("bg_med") + 5 * F.col("noise")
    at = F.when(hit, F.col("ch"))
    shape = lines.groupBy("obs_id").agg(
        F.least(F.greatest((F.max(m) - med) / F.first("noise"), F.lit(0.0)), F.lit(1e4)).alias("peak_snr"),
        F.least(F.greatest((F.sum(m) - med * n) / F.first("noise"), F.lit(0.0)), F.lit(1e6)).alias("integrated_snr"),
        F.avg(hit.cast("double")).alias("occupancy"), F.coalesce((F.max(at) - F.min(at) + 1) / n, F.lit(0.0)).alias("bandwidth"),
        _kurtosis("m").alias("spectral_kurtosis"),
    )
    out = shape.join(gini(means), "obs_id").join(drift_rate(rows, bg), "obs_id").join(flatness(means), "obs_id")
    return out.join(sub_bin_flatness(means), "obs_id").join(slice_kurtosis(rows), "obs_id")


def flatness(mean_ch: DataFrame, name: str = "spectral_flatness") -> DataFrame:
    """(obs_id, name): geometric over arithmetic mean of the positive values."""
    pos = F.when(F.col("m") > 0, F.col("m"))
    return mean_ch.groupBy("obs_id").agg(F.coalesce(F.exp(F.avg(F.log(pos))) / (F.avg(pos) + 1e-12), F.lit(1.0)).alias(name))


def sub_bin_flatness(mean_ch: DataFrame) -> DataFrame:
    """Flatness of the peak channel and its neighbours."""
    peak = mean_ch.withColumn("r", F.round("m", 6)).groupBy("obs_id").agg(F.max(F.struct("r", (-F.col("ch")).alias("i")))["i"].alias("i"))
    near = mean_ch.join(peak, "obs_id").where(F.abs(F.col("ch") + F.col("i")) <= 1)
    return flatness(near, "sub_bin_flatness")


def _kurtosis(value: str) -> Column:
    """Fourth moment over squared variance less 3, bounded; 0 without variance."""
    v = F.var_pop(value)
    k = (F.kurtosis(value) + 3) * v * v / (v * v + 1e-12) - 3
    return F.when(v > 0, F.least(F.greatest(k, F.lit(-10.0)), F.lit(1e4))).otherwise(0.0)


def slice_kurtosis(df: DataFrame) -> DataFrame:
    """Kurtosis over the channels of the time with the largest sample (the
    first of equals)."""
    best = df.groupBy("obs_id").agg(F.max(F.struct("power", (-F.col("t")).alias("i")))["i"].alias("i"))
    return df.join(best, "obs_id").where(F.col("t") == -F.col("i")).groupBy("obs_id").agg(_kurtosis("power").alias("slice_kurtosis"))


def narrowband_window(df: DataFrame, half_chan: int = 4, half_time: int = 4) -> DataFrame:
    """The samples around the brightest one: of the largest sample's time the
    strongest channel, and what lies within the half widths. Where that leaves
    fewer than two times, all times stay."""
    n = df.groupBy("obs_id").agg(
        (F.max("ch") + 1).alias("_nc"), (F.max("t") + 1).alias("_nt"), F.max(F.struct("power", (-F.col("t")).alias("t"), (-F.col("ch")).alias("c"))).alias("b")
    )
    half = F.greatest(F.lit(half_chan), F.floor(F.col("_nc") / 200))
    best = -F.col("b.t")
    alone = F.least(F.col("_nt"), best + half_time + 1) - F.greatest(F.lit(0), best - half_time) < 2
    near = df.join(n, "obs_id").where((alone | (F.abs(F.col("t") - best) <= half_time)) & (F.abs(F.col("ch") + F.col("b.c")) <= half))
    return near.drop("_nc", "_nt", "b")


#: Descriptors of the narrowband score, and what a missing one counts as.
NARROWBAND = {"concentration": 0.0, "spectral_flatness": 1.0, "sub_bin_flatness": 1.0, "spectral_kurtosis": 0.0, "slice_kurtosis": 0.0, "occupancy": 0.0}


def narrowband(columns: list[str]) -> Column:
    """The larger of a spectral and a carrier score, of those descriptors that
    are among the columns; null where a row has none of them."""
    have = {n: F.col(n) for n in NARROWBAND if n in columns}
    if not have:
        return F.lit(None).cast("double")
    value = {n: F.coalesce(have[n], F.lit(v)) if n in have else F.lit(v) for n, v in NARROWBAND.items()}
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    conc, flat, sub = unit(value["concentration"]), 1 - unit(value["spectral_flatness"]), 1 - unit(value["sub_bin_flatness"])
    kurt, slice_, narrow = unit(value["spectral_kurtosis"] / 20), unit(value["slice_kurtosis"] / 20), 1 - unit(value["occupancy"])
    spectral = 0.25 * conc + 0.2 * flat + 0.15 * kurt + 0.2 * sub + 0.2 * slice_
    carrier = 0.4 * kurt + 0.35 * slice_ + 0.25 * narrow
    return F.when(F.coalesce(*have.values()).isNotNull(), F.greatest(spectral, carrier))


def narrowband_score(d: DataFrame) -> DataFrame:
    """Adds narrowband: the score of each row's descriptors."""
    return d.withColumn("narrowband", narrowband(d.columns))


def carrier(x: np.ndarray) -> float:
    """Score of one channel's series: heavy tails in time, heavy tails of its
    power spectrum (the constant part left out) and steadiness around a positive
    mean; 0 under four samples. A part without variance is 0."""
    if len(x) < 4:
        return 0.0

    def tails(v: np.ndarray) -> float:
        d = v - v.mean()
        var = float((d * d).mean())
        # a variance that is rounding alone counts as none
        return min(max((float((d**4).mean()) / var**2 - 3) / 10, 0.0), 1.0) if var > 1e-20 * float((v * v).mean()) else 0.0

    spectrum = np.abs(np.fft.rfft(x))[1:] ** 2
    steady = min(max(1 - float(x.std() / x.mean()), 0.0), 1.0) if x.mean() > 0 else 0.0
    return 0.4 * tails(x) + 0.35 * (tails(spectrum) if len(spectrum) > 2 else 0.0) + 0.25 * steady


def windows(df: DataFrame, axis: str, window: int, stride: int, max_windows: int | None = None) -> DataFrame:
    """Cuts each observation into windows along t or ch: adds window_idx and
    the place within it. An axis shorter than the window gives no window."""
    n = df.groupBy("obs_id").agg((F.max(axis) + 1).alias("_n")).where(F.col("_n") >= window)
    starts = n.select("obs_id", F.posexplode(F.sequence(F.lit(0), F.col("_n") - window, F.lit(stride))).alias("window_idx", "_s"))
    if max_windows is not None:
        starts = starts.where(F.col("window_idx") < max_windows)
    rows = df.join(starts, "obs_id").where((F.col(axis) >= F.col("_s")) & (F.col(axis) < F.col("_s") + window))
    return rows.withColumn("at", F.col(axis) - F.col("_s")).drop("_s")


def plan_hash(**plan) -> str:
    """Stable 16-digit name of a window plan."""
    import hashlib

    return hashlib.sha256(repr(sorted(plan.items())).encode()).hexdigest()[:16]


def extract_features(df: DataFrame, t_samp: float, dm_max: float, n_dm: int) -> DataFrame:
    """The eleven features of each observation."""
    norm = normalize_bandpass(df)
    power = channel_power(df)
    best = dm_best(dm_sweep(norm, t_samp, dm_max, n_dm, "norm")).drop("dm0_snr")
    sk = spectral_kurtosis(power).withColumnRenamed("sk", "log_spectral_kurtosis")
    return best.join(band_shape(power), "obs_id").join(occupancy(norm), "obs_id").join(tone_persistence(df, power).drop("peak_ch"), "obs_id").join(sk, "obs_id")
