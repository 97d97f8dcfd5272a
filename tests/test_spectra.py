"""The descriptors and features of dynamic spectra against plain NumPy."""

import numpy as np
import pytest

from skysift.operators import waterfall as WF


def kurtosis(x):
    v = x.var()
    return min(max(((x - x.mean()) ** 4).mean() / (v * v + 1e-12) - 3, -10.0), 1e4) if v > 0 else 0.0


def flatness(m):
    m = m[m > 0]
    return np.exp(np.log(m).mean()) / (m.mean() + 1e-12) if len(m) else 1.0


def descriptors(x):
    """x: channels by times."""
    m = x.mean(axis=1)
    med = np.median(m)
    noise = max(1.5 * 1.4826 * 1.4826 * (np.median(abs(m - med)) + 1e-9), 1e-9)
    hit = np.flatnonzero(m > med + 5 * noise)
    w = np.maximum(x - med, 0)
    ch = np.arange(len(m))
    centre = [w[:, t] @ ch / w[:, t].sum() if w[:, t].sum() > 0 else x[:, t].argmax() for t in range(x.shape[1])]
    v = np.sort(m[m >= 0])
    i = np.arange(1, len(v) + 1)
    p = m.argmax()
    return {
        "peak_snr": np.clip((m.max() - med) / noise, 0, 1e4), "integrated_snr": np.clip((m.sum() - med * len(m)) / noise, 0, 1e6),
        "occupancy": len(hit) / len(m), "bandwidth": (hit.max() - hit.min() + 1) / len(m) if len(hit) else 0.0, "spectral_kurtosis": kurtosis(m),
        "drift_rate": np.polyfit(np.arange(x.shape[1]), centre, 1)[0], "slice_kurtosis": kurtosis(x[:, x.max(axis=0).argmax()]),
        "concentration": np.clip((2 * (i * v).sum() - (len(v) + 1) * v.sum()) / (len(v) * v.sum() + 1e-12), 0, 1),
        "spectral_flatness": flatness(m), "sub_bin_flatness": flatness(m[max(p - 1, 0) : p + 2]),
    }


def cases():
    rng = np.random.default_rng(3)
    noise = lambda: rng.normal(10, 1, (40, 24)).round(6)
    carrier, drifting, wide = noise(), noise(), noise()
    carrier[17] += 60 * (1 + 0.3 * np.sin(np.arange(24)))
    for t in range(24):
        drifting[5 + t, t] += 80
    wide += 8
    return {"noise": noise(), "carrier": carrier.round(6), "drifting": drifting, "wide": wide}


def long_form(spark, spectra):
    rows = [(k, t, c, 1500.0 - c, float(x[c, t])) for k, x in spectra.items() for c in range(x.shape[0]) for t in range(x.shape[1])]
    return spark.createDataFrame(rows, "obs_id string, t int, ch int, freq_mhz double, power double")


def test_descriptors(spark):
    spectra = cases()
    got = {r["obs_id"]: r.asDict() for r in WF.narrowband_score(WF.descriptors(long_form(spark, spectra))).collect()}
    for name, x in spectra.items():
        want = descriptors(x)
        for k, v in want.items():
            assert got[name][k] == pytest.approx(v, rel=1e-6, abs=1e-9), (name, k)
        kurt, slc = np.clip(want["spectral_kurtosis"] / 20, 0, 1), np.clip(want["slice_kurtosis"] / 20, 0, 1)
        spectral = 0.25 * want["concentration"] + 0.2 * (1 - want["spectral_flatness"]) + 0.15 * kurt + 0.2 * (1 - want["sub_bin_flatness"]) + 0.2 * slc
        assert got[name]["narrowband"] == pytest.approx(max(spectral, 0.4 * kurt + 0.35 * slc + 0.25 * (1 - want["occupancy"])), rel=1e-6)
    assert got["carrier"]["narrowband"] > got["noise"]["narrowband"]


def test_band_features(spark):
    spectra = cases()
    df = long_form(spark, spectra)
    power = WF.channel_power(df)
    shape = {r["obs_id"]: r["peak_channel_snr"] for r in WF.band_shape(power).collect()}
    sk = {r["obs_id"]: r["sk"] for r in WF.spectral_kurtosis(power, 8).collect()}
    tone = {r["obs_id"]: r["tone_persistence"] for r in WF.tone_persistence(df, power).collect()}
    for name, x in spectra.items():
        b = x - np.median(x, axis=1, keepdims=True)
        cp = (b * b).mean(axis=1)
        assert shape[name] == pytest.approx(cp.max() / (np.median(abs(cp - np.median(cp))) + 1e-9 + 1e-12), rel=1e-6)
        p = (cp.reshape(5, 8) ** 2).mean(axis=1)
        k = 5 / 4 * p.var() / (p.mean() ** 2 + 1e-12) - 1
        assert sk[name] == pytest.approx(-30.0 if k <= -1e-12 else np.log(k + 1e-12), rel=1e-6)
        n = np.median(abs(b - np.median(b))) + 1e-9
        assert tone[name] == pytest.approx((b[cp.argmax()] / (1.4826 * n) >= 5).mean(), abs=1e-9)
