"""Spectra that are split over tasks, against direct transforms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.operators import longwave, waveform

PROPS = "signal_id long, pos long, x double"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 97, 360, 1009])
@pytest.mark.parametrize("block", [1, 64, 1 << 18])
def test_passes_equal_a_direct_transform(n, block):
    """The three passes by hand: every group sees the tiles that are sent to it."""
    import pandas as pd

    x = np.random.default_rng(n).normal(size=n)
    s = longwave.Shape(n, block)
    assert s.m >= 2 * n - 1 and s.r * s.c == s.m and s.b * s.r <= max(block, s.r)
    rows = pd.DataFrame({"n": n, "pos": np.arange(n), "x": x, "to": np.arange(n) % s.c // s.b})
    for step in (longwave._columns, longwave._middle, longwave._rows):
        rows = pd.concat([step((7, to), g, block) for to, g in rows.groupby("to")])
    rows = rows.sort_values("k")
    want = np.fft.rfft(x)
    assert np.allclose(rows["re"] + 1j * rows["im"].to_numpy(), want, atol=1e-9 * n) and set(rows["k0"]) == {7}


def test_spectrum_of_many_signals(spark, monkeypatch):
    monkeypatch.setattr(longwave, "BLOCK", 256)
    rng = np.random.default_rng(0)
    signals = {1: rng.normal(size=1), 2: rng.normal(size=500), 3: np.full(300, 2.0), 4: np.sin(np.arange(1001) * 0.7), None: rng.normal(size=17)}
    rows = [(k, i, float(v)) for k, x in signals.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, PROPS).repartition(5)
    got = {}
    for r in longwave.spectrum(df, "signal_id").collect():
        got.setdefault(None if r["signal_id"] is None else int(r["signal_id"]), {})[r["k"]] = r["re"] + 1j * r["im"]
        assert r["n"] == len(signals[r["signal_id"]])
    assert got.keys() == signals.keys()
    for k, x in signals.items():
        want = np.fft.rfft(x)
        assert np.allclose([got[k][i] for i in range(len(want))], want, atol=1e-8) and len(got[k]) == len(want)


def test_null_samples_are_zero_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, 3.0)], PROPS)
    got = {r["k"]: complex(r["re"], r["im"]) for r in longwave.spectrum(df, "signal_id").collect()}
    assert np.allclose([got[k] for k in (0, 1)], np.fft.rfft([1.0, 0.0, 3.0]))
    assert longwave.spectrum(df.limit(0), "signal_id").count() == 0


def _tones():
    rng = np.random.default_rng(5)
    t = np.arange(1500) / 1000
    yield 1, np.sin(2 * np.pi * 60 * t) + 0.5 * np.sin(2 * np.pi * 120 * t) + 0.1 * rng.normal(size=len(t))
    yield 2, np.sin(2 * np.pi * (40 * t + 30 * t * t))
    yield 3, rng.normal(size=1201)
    yield 4, np.sin(2 * np.pi * 330 * np.arange(1111) / 1000)  # no harmonic under half the rate
    yield 5, np.zeros(900)
    yield 6, np.sin(np.arange(80))  # short
    yield 7, np.sin(np.arange(600) * np.pi / 2) + 0.01 * rng.normal(size=600)  # twice the peak is half the rate


def test_long_signals_have_the_values_of_short_ones(spark, monkeypatch):
    # gaps in pos: only the order counts
    rows = [(k, 3 * i + 10, float(v)) for k, x in _tones() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, PROPS).repartition(7)
    whole = {r["signal_id"]: r.asDict() for r in waveform.spectra(df, *waveform.SPECTRAL).collect()}
    monkeypatch.setattr(waveform, "LONG", 500)
    monkeypatch.setattr(longwave, "BLOCK", 512)
    monkeypatch.setattr(longwave, "PIECE", 100)
    split = {r["signal_id"]: r.asDict() for r in waveform.spectra(df, *waveform.SPECTRAL).collect()}
    assert split.keys() == whole.keys() == {1, 2, 3, 4, 5, 6, 7}
    for k in (1, 2, 3, 4, 6, 7):
        assert split[k] == pytest.approx(whole[k], rel=1e-6, abs=1e-9), k
    assert whole[1]["fft_freq"] == pytest.approx(60, abs=1) and whole[2]["drift_rate"] > 10
    # a flat signal has no peak: magnitudes are 0 but for rounding
    assert split[5]["fft_mag"] == pytest.approx(0, abs=1e-6) and split[5]["lz76"] == whole[5]["lz76"]
    one = {r["signal_id"]: r["harmonics"] for r in waveform.spectra(df, "harmonics").collect()}
    assert one[1] == pytest.approx(whole[1]["harmonics"], rel=1e-6)


def test_a_signal_of_many_blocks(spark):
    n = 300_000  # 2 ** 20 numbers, in 16 tasks a pass
    x = F.sin(F.col("id") * 2 * np.pi * 12_345 / n) + F.rand(3)
    df = spark.range(n).select(F.lit(1).cast("long").alias("signal_id"), F.col("id").alias("pos"), x.alias("x"))
    top = longwave.spectrum(df, "signal_id").where("k > 0").orderBy(F.desc(F.col("re") ** 2 + F.col("im") ** 2)).first()
    assert top["k"] == 12_345 and np.hypot(top["re"], top["im"]) == pytest.approx(n / 2, rel=0.01)
