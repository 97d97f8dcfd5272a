"""The narrowband term and the carrier score against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.operators import fusion
from skysift.operators import waterfall as WF


def plain_score(d):
    d = {k: v for k, v in d.items() if v is not None}
    if not d:
        return None
    c = lambda v: min(max(v, 0.0), 1.0)
    get = lambda k, v: d.get(k, v)
    conc, flat, sub = c(get("concentration", 0)), 1 - c(get("spectral_flatness", 1)), 1 - c(get("sub_bin_flatness", 1))
    kurt, cut, occ = c(get("spectral_kurtosis", 0) / 20), c(get("slice_kurtosis", 0) / 20), 1 - c(get("occupancy", 0))
    return max(0.25 * conc + 0.2 * flat + 0.15 * kurt + 0.2 * sub + 0.2 * cut, 0.4 * kurt + 0.35 * cut + 0.25 * occ)


def test_score_with_missing_descriptors(spark):
    rng = np.random.default_rng(2)
    names = list(WF.NARROWBAND)
    rows = [[None if rng.random() < 0.3 else float(rng.normal(0.5, 1) * (20 if "kurt" in n else 1)) for n in names] for _ in range(200)] + [[None] * 6]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: r["narrowband"] for r in WF.narrowband_score(df).collect()}
    for i, r in enumerate(rows):
        want = plain_score(dict(zip(names, r, strict=True)))
        assert got[i] is None if want is None else got[i] == pytest.approx(want)
    two = WF.narrowband_score(df.select("id", "concentration")).collect()
    assert all(r["narrowband"] == pytest.approx(plain_score({"concentration": r["concentration"]})) for r in two if r["concentration"] is not None)


def test_composite_uses_the_score(spark):
    base = "1 AS signal_id, 0.2D AS p_h, CAST(NULL AS DOUBLE) AS p_d, 0.5D AS p0, 0.3D AS p1, 0.2D AS p2, CAST(NULL AS DOUBLE) AS chaos, CAST(NULL AS DOUBLE) AS dm"
    rest = "CAST(NULL AS DOUBLE) AS dm_gal_max, CAST(NULL AS DOUBLE) AS width_ms, CAST(NULL AS DOUBLE) AS period_s, false AS is_extragalactic"
    low, high = (spark.sql(f"SELECT {base}, {rest}, {c}D AS concentration, {f}D AS spectral_flatness, {k}D AS spectral_kurtosis, 0.0D AS slice_kurtosis") for c, f, k in ((0.6, 0.5, 0), (0.6, 0.5, 20)))
    a, b = (fusion.with_evidence(x).first()["composite"] for x in (low, high))
    assert b - a == pytest.approx(50 * (plain_score({"concentration": 0.6, "spectral_flatness": 0.5, "spectral_kurtosis": 20}) - plain_score({"concentration": 0.6, "spectral_flatness": 0.5})) / 4)


def kurtosis(v):
    return np.mean((v - v.mean()) ** 4) / v.var() ** 2 - 3 if v.var() > 0 else 0.0


@pytest.mark.parametrize("kind", ["noise", "pulse", "constant", "below nought", "ramp", "short"])
def test_carrier(kind):
    rng = np.random.default_rng(3)
    x = {"noise": rng.normal(5, 1, 64), "pulse": np.r_[np.zeros(60), 9.0, np.zeros(3)], "constant": np.full(31, 2.0), "below nought": rng.normal(-5, 0.1, 40), "ramp": np.arange(12.0), "short": np.ones(3)}[kind]
    power = np.abs(np.fft.fft(x)[1 : len(x) // 2 + 1]) ** 2
    parts = [np.clip(kurtosis(x) / 10, 0, 1), np.clip(kurtosis(power) / 10, 0, 1), np.clip(1 - x.std() / abs(x.mean()), 0, 1) if x.mean() > 0 else 0.0]
    want = 0.0 if len(x) < 4 else 0.4 * parts[0] + 0.35 * parts[1] + 0.25 * parts[2]
    assert WF.carrier(x) == pytest.approx(want, abs=1e-9)
    if kind == "constant":
        assert WF.carrier(x) == 0.25


def test_neutral_without_descriptors(spark):
    df = spark.sql("SELECT 1 AS id, CAST(NULL AS DOUBLE) AS concentration")
    assert df.select(F.coalesce(WF.narrowband(df.columns), F.lit(0.5))).first()[0] == 0.5
    assert df.select(WF.narrowband(["id"])).first()[0] is None
