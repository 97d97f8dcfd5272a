"""Queries over dynamic spectra and waveforms."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import longwave as LW
from ..operators import waterfall as WF
from ..operators import waveform as WV
from ..sources import adapters as A
from .registry import query, with_

DM_MAX, N_DM = 100.0, 21

_CH = """
cmed AS (SELECT obs_id, ch, median(power) AS med, max(power) = min(power) AS flat FROM waterfall GROUP BY obs_id, ch),
cmad AS (SELECT w.obs_id, w.ch, any_value(med) AS med, any_value(flat) AS flat, median(abs(power - med)) AS mad FROM waterfall w JOIN cmed c ON w.obs_id = c.obs_id AND w.ch = c.ch GROUP BY w.obs_id, w.ch)"""
_NORM = "norm AS (SELECT w.obs_id, w.t, w.ch, w.freq_mhz, CASE WHEN flat THEN 0.0 ELSE (power - med) / (1.4826 * (mad + 1e-12)) END AS norm FROM waterfall w JOIN cmad c ON w.obs_id = c.obs_id AND w.ch = c.ch)"
_POWER = "cp AS (SELECT w.obs_id, w.ch, avg((power - med) * (power - med)) AS ch_power FROM waterfall w JOIN cmed c ON w.obs_id = c.obs_id AND w.ch = c.ch GROUP BY w.obs_id, w.ch)"
_CPM = """
pm AS (SELECT obs_id, median(ch_power) AS med FROM cp GROUP BY obs_id),
pd AS (SELECT cp.obs_id, any_value(med) AS med, median(abs(ch_power - med)) + 1e-9 AS mad FROM cp JOIN pm ON cp.obs_id = pm.obs_id GROUP BY cp.obs_id)"""
_SWEEP = f"""
grid AS (SELECT DISTINCT obs_id, ch, freq_mhz FROM waterfall),
lag AS (SELECT obs_id, ch, CAST(i AS INTEGER) AS dm_idx, i * {DM_MAX / (N_DM - 1)}::DOUBLE AS dm,
  CAST(round_even(4148.808::DOUBLE * (i * {DM_MAX / (N_DM - 1)}::DOUBLE) * (1 / (freq_mhz * freq_mhz) - 1 / (top * top)) / {A.T_SAMP}::DOUBLE, 0) AS INTEGER) AS shift
  FROM grid JOIN (SELECT obs_id, max(freq_mhz) AS top FROM grid GROUP BY obs_id) USING (obs_id), (SELECT unnest(range({N_DM})) AS i)),
ok AS (SELECT obs_id, dm_idx FROM lag GROUP BY obs_id, dm_idx HAVING max(shift) < {A.N_TIME}),
prof AS (SELECT w.obs_id, l.dm_idx, l.dm, w.t - l.shift AS t, sum(w.power) AS profile FROM waterfall w JOIN lag l ON w.obs_id = l.obs_id AND w.ch = l.ch
  JOIN ok ON ok.obs_id = l.obs_id AND ok.dm_idx = l.dm_idx WHERE w.t - l.shift >= 0 GROUP BY ALL),
sweep AS (SELECT obs_id, dm_idx, dm, round(CASE WHEN stddev_pop(profile) > 0 THEN greatest(max(profile) - median(profile), median(profile) - min(profile)) / stddev_pop(profile) ELSE 0 END, 6) AS snr
  FROM prof GROUP BY obs_id, dm_idx, dm)"""


def _w(s, d):
    return A.waterfall(s, d)


def _r(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@query("channel_frequencies", with_(A.WATERFALL) + "SELECT DISTINCT obs_id, ch, freq_mhz * 1e6 AS freq_hz FROM waterfall")
def channel_frequencies(s, d):
    return _w(s, d).select("obs_id", "ch", (F.col("freq_mhz") * 1e6).alias("freq_hz")).distinct()


@query("repair_samples", with_(A.WATERFALL) + """, broken AS (SELECT obs_id, t, ch, CASE WHEN (t * 7 + ch) % 11 <> 0 THEN power END AS power FROM waterfall)
SELECT obs_id, t, ch, round(coalesce(power, median(power) OVER (PARTITION BY obs_id, ch), 0.0), 6) AS power FROM broken""")
def repair_samples(s, d):
    broken = _w(s, d).withColumn("power", F.when((F.col("t") * 7 + F.col("ch")) % 11 != 0, F.col("power")).otherwise(float("nan")))
    return WF.repair(broken).select("obs_id", "t", "ch", F.round("power", 6).alias("power"))


@query("bandpass_normalize", with_(A.WATERFALL, _CH, _NORM) + "SELECT obs_id, t, ch, round(norm, 6) AS norm FROM norm")
def bandpass_normalize(s, d):
    return WF.normalize_bandpass(_w(s, d)).select("obs_id", "t", "ch", F.round("norm", 6).alias("norm"))


@query("dedisperse_profile", with_(A.WATERFALL, _SWEEP) + "SELECT obs_id, dm_idx, t, round(profile, 6) AS profile FROM prof")
def dedisperse_profile(s, d):
    return WF.dedisperse(_w(s, d), A.T_SAMP, DM_MAX, N_DM).select("obs_id", "dm_idx", "t", F.round("profile", 6).alias("profile"))


@query("dm_sweep", with_(A.WATERFALL, _SWEEP) + "SELECT obs_id, dm_idx, dm, snr FROM sweep")
def dm_sweep(s, d):
    return WF.dm_sweep(_w(s, d), A.T_SAMP, DM_MAX, N_DM).select("obs_id", "dm_idx", "dm", F.round("snr", 6).alias("snr"))


@query("dm_best", with_(A.WATERFALL, _SWEEP) + """SELECT obs_id, first(dm ORDER BY snr DESC, dm_idx) AS best_dm, max(snr) AS best_snr, max(CASE WHEN dm_idx = 0 THEN snr END) AS dm0_snr,
  round(max(CASE WHEN dm_idx = 0 THEN snr END) / (max(snr) + 1e-12), 6) AS dm0_peak_ratio, round(least(greatest(max(snr) / avg(snr) - 1, 0.0), 10.0), 6) AS dm_curve_sharpness FROM sweep GROUP BY obs_id""")
def dm_best(s, d):
    b = WF.dm_best(WF.dm_sweep(_w(s, d), A.T_SAMP, DM_MAX, N_DM))
    return b.select("obs_id", "best_dm", "best_snr", "dm0_snr", *_r("dm0_peak_ratio", "dm_curve_sharpness"))


@query("channel_power", with_(A.WATERFALL, _CH, _POWER) + "SELECT obs_id, ch, round(ch_power, 6) AS ch_power FROM cp")
def channel_power(s, d):
    return WF.channel_power(_w(s, d)).select("obs_id", "ch", F.round("ch_power", 6).alias("ch_power"))


@query("band_shape", with_(A.WATERFALL, _CH, _POWER, _CPM) + """SELECT cp.obs_id, round(avg(CASE WHEN ch_power > med + 8 * mad THEN 1.0 ELSE 0.0 END), 6) AS narrowband_fraction,
  round(max(ch_power) / (any_value(mad) + 1e-12), 6) AS peak_channel_snr, round(coalesce(sum((ch_power - a) ** 3) / count(*) / stddev_pop(ch_power) ** 3, 0), 6) AS band_skewness,
  round(coalesce(kurtosis_pop(ch_power), 0), 6) AS band_kurtosis FROM cp JOIN pd ON cp.obs_id = pd.obs_id JOIN (SELECT obs_id, avg(ch_power) AS a FROM cp GROUP BY obs_id) m ON m.obs_id = cp.obs_id GROUP BY cp.obs_id""")
def band_shape(s, d):
    return WF.band_shape(WF.channel_power(_w(s, d))).select("obs_id", *_r("narrowband_fraction", "peak_channel_snr", "band_skewness", "band_kurtosis"))


@query("narrowband_fraction", with_(A.WATERFALL, _CH, _POWER, _CPM) + "SELECT cp.obs_id, round(avg(CASE WHEN ch_power > med + 2 * mad THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM cp JOIN pd ON cp.obs_id = pd.obs_id GROUP BY cp.obs_id")
def narrowband_fraction(s, d):
    rows = WF._med_mad(WF.channel_power(_w(s, d)), "ch_power")
    return rows.groupBy("obs_id").agg(F.round(F.avg((F.col("ch_power") > F.col("_med") + 2 * (F.col("_mad") + 1e-9)).cast("double")), 6).alias("fraction"))


@query("spectral_kurtosis", with_(A.WATERFALL, _CH, _POWER) + """, c AS (SELECT obs_id, count(*) AS n, CASE WHEN count(*) < 128 THEN greatest(1, count(*) // 2) ELSE 64 END AS size FROM cp GROUP BY obs_id),
g AS (SELECT cp.obs_id, ch // size AS seg, any_value(n // size) AS k, avg(ch_power * ch_power) AS p FROM cp JOIN c ON cp.obs_id = c.obs_id WHERE ch // size < n // size GROUP BY cp.obs_id, ch // size),
e AS (SELECT obs_id, any_value(k) / (any_value(k) - 1) * var_pop(p) / (avg(p) * avg(p) + 1e-12) - 1 AS sk FROM g GROUP BY obs_id)
SELECT obs_id, round(CASE WHEN sk <= -1e-12 THEN -30.0 ELSE ln(CASE WHEN sk > -1e-12 THEN sk + 1e-12 END) END, 6) AS sk FROM e""")
def spectral_kurtosis(s, d):
    return WF.spectral_kurtosis(WF.channel_power(_w(s, d))).select("obs_id", F.round("sk", 6).alias("sk"))


@query("waterfall_occupancy", with_(A.WATERFALL, _CH, _NORM) + "SELECT n.obs_id, round(avg(CASE WHEN abs(norm) > 5 * s THEN 1.0 ELSE 0.0 END), 6) AS occupancy FROM norm n JOIN (SELECT obs_id, stddev_pop(norm) AS s FROM norm GROUP BY obs_id) x ON n.obs_id = x.obs_id GROUP BY n.obs_id")
def waterfall_occupancy(s, d):
    return WF.occupancy(WF.normalize_bandpass(_w(s, d))).select("obs_id", F.round("occupancy", 6).alias("occupancy"))


@query("tone_persistence", with_(A.WATERFALL, _CH, _POWER) + """, pk AS (SELECT obs_id, first(ch ORDER BY round(ch_power, 6) DESC, ch) AS ch FROM cp GROUP BY obs_id),
bp AS (SELECT w.obs_id, w.ch, power - med AS x FROM waterfall w JOIN cmed c ON w.obs_id = c.obs_id AND w.ch = c.ch),
nz AS (SELECT bp.obs_id, median(abs(x - c)) + 1e-9 AS noise FROM bp JOIN (SELECT obs_id, median(x) AS c FROM bp GROUP BY obs_id) y ON bp.obs_id = y.obs_id GROUP BY bp.obs_id)
SELECT bp.obs_id, bp.ch AS peak_ch, round(avg(CASE WHEN x / (1.4826 * noise) >= 5 THEN 1.0 ELSE 0.0 END), 6) AS tone_persistence
FROM bp JOIN pk ON bp.obs_id = pk.obs_id AND bp.ch = pk.ch JOIN nz ON nz.obs_id = bp.obs_id GROUP BY bp.obs_id, bp.ch""")
def tone_persistence(s, d):
    w = _w(s, d)
    return WF.tone_persistence(w, WF.channel_power(w)).select("obs_id", "peak_ch", F.round("tone_persistence", 6).alias("tone_persistence"))


_BG = """
cm AS (SELECT obs_id, ch, avg(power) AS m FROM waterfall GROUP BY obs_id, ch), cmm AS (SELECT obs_id, median(m) AS med FROM cm GROUP BY obs_id),
bg AS (SELECT cm.obs_id, any_value(med) AS bg_med, 1.4826 * (median(abs(m - med)) + 1e-9) AS bg_noise FROM cm JOIN cmm ON cm.obs_id = cmm.obs_id GROUP BY cm.obs_id)"""


@query("robust_background", with_(A.WATERFALL, _BG) + "SELECT obs_id, round(bg_med, 6) AS bg_med, round(bg_noise, 6) AS bg_noise FROM bg")
def robust_background(s, d):
    return WF.background(WF.channel_means(_w(s, d))).select("obs_id", *_r("bg_med", "bg_noise"))


_GINI = """
gini AS (SELECT obs_id, CASE WHEN sum(m) > 0 THEN least(greatest((2 * sum(i * m) - (count(*) + 1) * sum(m)) / (count(*) * sum(m) + 1e-12), 0.0), 1.0) ELSE 0.0 END AS concentration
  FROM (SELECT obs_id, m, row_number() OVER (PARTITION BY obs_id ORDER BY m) AS i FROM cm WHERE m >= 0) GROUP BY obs_id)"""


@query("gini_concentration", with_(A.WATERFALL, _BG, _GINI) + "SELECT obs_id, round(concentration, 6) AS concentration FROM gini")
def gini_concentration(s, d):
    return WF.gini(WF.channel_means(_w(s, d))).select("obs_id", F.round("concentration", 6).alias("concentration"))


_DRIFT = """
above AS (SELECT w.obs_id, t, ch, power, greatest(power - bg_med, 0.0) AS w FROM waterfall w JOIN bg ON w.obs_id = bg.obs_id),
drift AS (SELECT obs_id, coalesce(regr_slope(c, t), 0) AS drift_rate FROM (
  SELECT obs_id, t, CASE WHEN sum(w) > 0 THEN sum(ch * w) / sum(w) ELSE first(ch ORDER BY power DESC, ch) END AS c FROM above GROUP BY obs_id, t) GROUP BY obs_id)"""


@query("drift_rate_slope", with_(A.WATERFALL, _BG, _DRIFT) + "SELECT obs_id, round(drift_rate, 6) AS drift_rate FROM drift")
def drift_rate_slope(s, d):
    w = _w(s, d)
    return WF.drift_rate(w, WF.background(WF.channel_means(w))).select("obs_id", F.round("drift_rate", 6).alias("drift_rate"))


_FLAT = "flatn AS (SELECT obs_id, coalesce(exp(avg(CASE WHEN m > 0 THEN ln(CASE WHEN m > 0 THEN m END) END)) / (avg(CASE WHEN m > 0 THEN m END) + 1e-12), 1.0) AS spectral_flatness FROM cm GROUP BY obs_id)"


@query("spectral_flatness", with_(A.WATERFALL, _BG, _FLAT) + "SELECT obs_id, round(spectral_flatness, 6) AS spectral_flatness FROM flatn")
def spectral_flatness(s, d):
    means = _w(s, d).groupBy("obs_id", "ch").agg(F.avg("power").alias("m"))
    return WF.flatness(means).select("obs_id", F.round("spectral_flatness", 6).alias("spectral_flatness"))


_KURT = "CASE WHEN var_pop({0}) > 0 THEN least(greatest((kurtosis_pop({0}) + 3) * var_pop({0}) * var_pop({0}) / (var_pop({0}) * var_pop({0}) + 1e-12) - 3, -10.0), 1e4) ELSE 0.0 END"
_DESC = f"""
th AS (SELECT cm.*, bg_med, greatest(1.5 * 1.4826 * bg_noise, 1e-9) AS noise, bg_med + 5 * greatest(1.5 * 1.4826 * bg_noise, 1e-9) AS thr FROM cm JOIN bg ON cm.obs_id = bg.obs_id),
pk AS (SELECT obs_id, least(greatest((max(m) - any_value(bg_med)) / any_value(noise), 0.0), 1e4) AS peak_snr, least(greatest((sum(m) - any_value(bg_med) * count(*)) / any_value(noise), 0.0), 1e6) AS integrated_snr,
  avg(CASE WHEN m > thr THEN 1.0 ELSE 0.0 END) AS occupancy, coalesce((max(CASE WHEN m > thr THEN ch END) - min(CASE WHEN m > thr THEN ch END) + 1) / count(*), 0.0) AS bandwidth,
  {_KURT.format("m")} AS spectral_kurtosis FROM th GROUP BY obs_id),
pc AS (SELECT obs_id, first(ch ORDER BY round(m, 6) DESC, ch) AS pch FROM cm GROUP BY obs_id),
sb AS (SELECT cm.obs_id, coalesce(exp(avg(CASE WHEN m > 0 THEN ln(CASE WHEN m > 0 THEN m END) END)) / (avg(CASE WHEN m > 0 THEN m END) + 1e-12), 1.0) AS sub_bin_flatness FROM cm JOIN pc ON cm.obs_id = pc.obs_id WHERE abs(ch - pch) <= 1 GROUP BY cm.obs_id),
bt AS (SELECT obs_id, first(t ORDER BY power DESC, t) AS bt FROM waterfall GROUP BY obs_id),
sl AS (SELECT w.obs_id, {_KURT.format("power")} AS slice_kurtosis FROM waterfall w JOIN bt ON w.obs_id = bt.obs_id AND t = bt GROUP BY w.obs_id),
dd AS (SELECT * FROM pk JOIN gini USING (obs_id) JOIN drift USING (obs_id) JOIN flatn USING (obs_id) JOIN sb USING (obs_id) JOIN sl USING (obs_id))"""
_TEN = ("peak_snr", "integrated_snr", "occupancy", "concentration", "drift_rate", "bandwidth", "spectral_flatness", "sub_bin_flatness", "spectral_kurtosis", "slice_kurtosis")


@query("waterfall_descriptors", with_(A.WATERFALL, _BG, _GINI, _DRIFT, _FLAT, _DESC) + "SELECT obs_id, " + ", ".join(f"round({c}, 5) AS {c}" for c in _TEN) + " FROM dd")
def waterfall_descriptors(s, d):
    return WF.descriptors(_w(s, d)).select("obs_id", *[F.round(c, 5).alias(c) for c in _TEN])


@query("bandwidth_occupancy", with_(A.WATERFALL, _BG, _GINI, _DRIFT, _FLAT, _DESC) + "SELECT obs_id, round(bandwidth, 6) AS bandwidth, round(occupancy, 6) AS occupancy FROM dd")
def bandwidth_occupancy(s, d):
    return WF.descriptors(_w(s, d)).select("obs_id", *_r("bandwidth", "occupancy"))


_U = "least(greatest({}, 0.0), 1.0)"
_K, _S = _U.format("spectral_kurtosis / 20"), _U.format("slice_kurtosis / 20")
_SPEC = f"0.25 * {_U.format('concentration')} + 0.2 * (1 - {_U.format('spectral_flatness')}) + 0.15 * {_K} + 0.2 * (1 - {_U.format('sub_bin_flatness')}) + 0.2 * {_S}"
_CARR = f"0.4 * {_K} + 0.35 * {_S} + 0.25 * (1 - {_U.format('occupancy')})"


@query("narrowband_score", with_(A.WATERFALL, _BG, _GINI, _DRIFT, _FLAT, _DESC) + f"SELECT obs_id, round(greatest({_SPEC}, {_CARR}), 6) AS narrowband FROM dd")
def narrowband_score(s, d):
    return WF.narrowband_score(WF.descriptors(_w(s, d))).select("obs_id", F.round("narrowband", 6).alias("narrowband"))


@query("narrowband_window", with_(A.WATERFALL) + """, b AS (SELECT obs_id, first(t ORDER BY power DESC, t, ch) AS bt, first(ch ORDER BY power DESC, t, ch) AS bc FROM waterfall GROUP BY obs_id)
SELECT w.obs_id, count(*) AS n, round(sum(power), 6) AS total FROM waterfall w JOIN b ON w.obs_id = b.obs_id WHERE abs(t - bt) <= 4 AND abs(ch - bc) <= 4 GROUP BY w.obs_id""")
def narrowband_window(s, d):
    return WF.narrowband_window(_w(s, d)).groupBy("obs_id").agg(F.count("*").alias("n"), F.round(F.sum("power"), 6).alias("total"))


@query("sliding_windows", with_(A.WATERFALL) + """SELECT obs_id, CAST(k AS INTEGER) AS window_idx, count(*) AS n, round(avg(power) + 1e-9, 6) AS mean_power FROM waterfall, (SELECT unnest(range(6)) AS k)
WHERE t >= k * 4 AND t < k * 4 + 8 GROUP BY obs_id, k""")
def sliding_windows(s, d):
    w = WF.windows(_w(s, d), "t", 8, 4, 6)
    return w.groupBy("obs_id", "window_idx").agg(F.count("*").alias("n"), F.round(F.avg("power") + 1e-9, 6).alias("mean_power"))


@query("waterfall_features")
def waterfall_features(s, d):
    return WF.extract_features(_w(s, d), A.T_SAMP, DM_MAX, N_DM)


# waveforms


@query("shannon_entropy", with_(A.WAVES) + f""", e AS (SELECT signal_id, min(x) AS lo, max(x) AS hi, count(*) AS n FROM waves GROUP BY signal_id),
c AS (SELECT w.signal_id, count(*) / any_value(n) AS p FROM waves w JOIN e ON w.signal_id = e.signal_id WHERE hi > lo GROUP BY w.signal_id, least(floor((x - lo) / (hi - lo) * 128), 127)),
h AS (SELECT signal_id, -sum(p * log2(p)) / {math.log2(128)} AS h FROM c GROUP BY signal_id)
SELECT e.signal_id, round(coalesce(least(greatest(h, 0.0), 1.0), 0.0), 6) AS entropy FROM e LEFT JOIN h ON e.signal_id = h.signal_id""")
def shannon_entropy(s, d):
    return WV.shannon_entropy(A.waves(s, d)).select("signal_id", F.round("entropy", 6).alias("entropy"))


@query("permutation_entropy", with_(A.WAVES) + f""", r AS (SELECT signal_id, x AS a, lead(x, 1) OVER w AS b, lead(x, 2) OVER w AS c FROM waves WINDOW w AS (PARTITION BY signal_id ORDER BY pos)),
k AS (SELECT signal_id, count(*) AS n FROM r WHERE c IS NOT NULL GROUP BY signal_id, a <= b, b <= c, a <= c), p AS (SELECT signal_id, n / sum(n) OVER (PARTITION BY signal_id) AS p FROM k),
h AS (SELECT signal_id, -sum(p * log2(p)) / {math.log2(6)} AS h FROM p GROUP BY signal_id)
SELECT s.signal_id, round(least(coalesce(h, 0.0), 1.0), 6) AS permutation_entropy FROM (SELECT DISTINCT signal_id FROM waves) s LEFT JOIN h ON s.signal_id = h.signal_id""")
def permutation_entropy(s, d):
    return WV.permutation_entropy(A.waves(s, d)).select("signal_id", F.round("permutation_entropy", 6).alias("permutation_entropy"))


@query("higuchi_dimension", with_(A.WAVES) + """, n AS (SELECT signal_id, count(*) AS n FROM waves GROUP BY signal_id),
p AS (SELECT a.signal_id, n.n, k, a.pos % k AS m, sum(abs(b.x - a.x)) AS d FROM waves a JOIN n ON n.signal_id = a.signal_id, (SELECT unnest(range(1, 11)) AS k)
  JOIN waves b ON b.signal_id = a.signal_id AND b.pos = a.pos + k GROUP BY ALL),
c AS (SELECT signal_id, n, k, avg(d * (n - 1) / (floor((n - m - 1) / k) * k) / k) AS l FROM p WHERE floor((n - m - 1) / k) > 0 GROUP BY ALL),
f AS (SELECT signal_id, regr_slope(ln(l), -ln(k)) AS s FROM c WHERE l > 0 GROUP BY signal_id)
SELECT n.signal_id, round(CASE WHEN n < 20 OR s IS NULL THEN 1.5 ELSE least(greatest(s, 1.0), 2.0) END, 6) AS fractal_dimension FROM n LEFT JOIN f ON n.signal_id = f.signal_id""")
def higuchi_dimension(s, d):
    return WV.higuchi_dimension(A.waves(s, d)).select("signal_id", F.round("fractal_dimension", 6).alias("fractal_dimension"))


@query("intensity_sigma", with_(A.WAVES) + "SELECT signal_id, round(greatest(max(x) - avg(x), avg(x) - min(x)) / (stddev_pop(x) + 1e-12), 6) AS intensity_sigma FROM waves GROUP BY signal_id")
def intensity_sigma(s, d):
    return WV.intensity_sigma(A.waves(s, d)).select("signal_id", F.round("intensity_sigma", 6).alias("intensity_sigma"))


@query("delay_embedding", with_(A.WAVES) + "SELECT * FROM (SELECT signal_id, pos, " + ", ".join(f"lead(x, {2 * i}) OVER w AS e{i}" for i in range(5)) + " FROM waves WINDOW w AS (PARTITION BY signal_id ORDER BY pos)) WHERE e4 IS NOT NULL")
def delay_embedding(s, d):
    return WV.delay_embedding(A.waves(s, d))


@query("lz76_complexity")
def lz76_complexity(s, d):
    return WV.spectra(A.waves(s, d), "lz76")


_LINES = """sized AS (SELECT signal_id, pos, x, count(*) OVER (PARTITION BY signal_id) AS size FROM waves),
parts AS (
  SELECT signal_id, 0 AS part, pos, x, size AS n FROM sized
  UNION ALL SELECT signal_id, pos // (size // 4) + 1, pos % (size // 4), x, size // 4 FROM sized WHERE size >= 64 AND pos < size // 4 * 4
), lines AS (
  SELECT signal_id, part, n, k, k * (1.0::DOUBLE / (n * 0.001::DOUBLE)) AS f, sum(x * cos(2 * pi() * ((k * pos) % n) / n)) ** 2 + sum(x * sin(2 * pi() * ((k * pos) % n) / n)) ** 2 AS power
  FROM (SELECT *, unnest(range(1, n // 2 + 1)) AS k FROM parts) GROUP BY ALL
), tops AS (SELECT signal_id, part, n, arg_max(f, power) AS freq, max(power) AS most FROM lines GROUP BY ALL)"""


@query(
    "fft_peaks",
    with_(A.WAVES, _LINES) + """, slopes AS (SELECT signal_id, regr_slope(freq, (part - 0.5) * n / 1000) AS slope FROM tops WHERE part > 0 GROUP BY signal_id)
SELECT i.signal_id, round(coalesce(freq, 0), 6) AS fft_freq, round(coalesce(sqrt(most), 0), 6) AS fft_mag, round(CASE WHEN abs(slope) >= 0.5 THEN slope ELSE 0 END, 6) AS drift_rate
FROM (SELECT DISTINCT signal_id FROM waves) i LEFT JOIN tops t ON t.signal_id = i.signal_id AND part = 0 LEFT JOIN slopes s ON s.signal_id = i.signal_id""",
)
def fft_peaks(s, d):
    names = ("fft_freq", "fft_mag", "drift_rate")
    return WV.spectra(A.waves(s, d), *names).select("signal_id", *[F.round(c, 6).alias(c) for c in names])


@query(
    "harmonic_complexity",
    with_(A.WAVES, _LINES) + """, heard AS (
  SELECT t.signal_id, m, coalesce(max(power) FILTER (abs(f - m * freq) <= greatest(1.5::DOUBLE * (1.0::DOUBLE / (t.n * 0.001::DOUBLE)), 2)), 0) / any_value(most) AS share
  FROM (SELECT *, unnest([2, 3, 4, 5]) AS m FROM tops WHERE part = 0 AND n >= 4 AND most > 0) t JOIN lines l ON l.signal_id = t.signal_id AND l.part = 0
  WHERE m * freq <= 500 GROUP BY t.signal_id, m
)
SELECT i.signal_id, round(coalesce(avg(share), 0), 6) AS harmonics FROM (SELECT DISTINCT signal_id FROM waves) i LEFT JOIN heard USING (signal_id) GROUP BY i.signal_id""",
)
def harmonic_complexity(s, d):
    return WV.spectra(A.waves(s, d), "harmonics").select("signal_id", F.round("harmonics", 6).alias("harmonics"))


@query("lyapunov_mle")
def lyapunov_mle(s, d):
    return WV.exponents(A.waves(s, d)).select("signal_id", "lyapunov")


@query("chaos_order")
def chaos_order(s, d):
    return WV.chaos(A.waves(s, d))


#: Bands of a series' spectrum.
BANDS = 64


@query(
    "series_periodogram",
    f"""WITH s AS (
  SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, value AS x, count(*) OVER (PARTITION BY event_type) AS n FROM events
), f AS (
  SELECT series, n, k, sum(x * cos(2 * pi() * ((k * pos) % n) / n)) AS re, sum(x * sin(2 * pi() * ((k * pos) % n) / n)) AS im
  FROM (SELECT *, unnest(range(1, n // 2 + 1)) AS k FROM s) GROUP BY ALL
), p AS (SELECT series, n, k, re * re + im * im AS power, CAST((k - 1) * {BANDS} // (n // 2) AS INTEGER) AS band FROM f)
SELECT series, band, count(*) AS n_lines, arg_max(k, power) AS peak, round(sum(power) / max(total), 8) AS share
FROM p JOIN (SELECT series, sum(power) AS total FROM p GROUP BY series) USING (series) GROUP BY series, band""",
)
def series_periodogram(s, d):
    """(series, band, n_lines, peak, share): the spectrum of all values of an event
    type, one after the other, as one signal that no task holds: each band's
    strongest line and its share of the power."""
    e = A.table(s, d, "events").select(F.col("event_type").alias("series"), "event_id", F.col("value").alias("x"))
    lines = LW.spectrum(LW.numbered(e, "event_id", "series"), "series").where("k > 0")
    band = F.floor((F.col("k") - 1) * BANDS / F.floor(F.col("n") / 2)).cast("int")
    lines = lines.select("series", "k", band.alias("band"), (F.col("re") ** 2 + F.col("im") ** 2).alias("power"))
    bands = lines.groupBy("series", "band").agg(F.count("*").alias("n_lines"), F.max_by("k", "power").alias("peak"), F.sum("power").alias("power"))
    total = F.sum("power").over(W.partitionBy("series"))  # a row for each band
    return bands.select("series", "band", "n_lines", "peak", F.round(F.col("power") / total, 8).alias("share"))
