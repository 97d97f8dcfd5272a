"""Waveform operators on signals that are longer than one block."""

import numpy as np
import pytest

from skysift.operators import waveform


def test_exponents_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=300))
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "signal_id long, pos int, x double")
    whole = waveform.exponents(df).first()["lyapunov"]
    n = len(x) - 8  # one dense matrix, as a plain version
    total, count = waveform.divergence(x, 0, n)
    want = np.polyfit(np.arange(9) / 1000, total / count, 1)[0]
    assert whole == pytest.approx(want) and want > 0
    monkeypatch.setattr(waveform, "BLOCK", 50 * n)
    assert waveform.exponents(df).first()["lyapunov"] == pytest.approx(want)


def test_a_long_signal_needs_no_dense_matrix(spark):
    n = 20_000  # n x n distances are 3 GB
    df = spark.range(n).selectExpr("1L AS signal_id", "CAST(id AS int) AS pos", "sin(id / 3) + rand(1) AS x")
    assert waveform.exponents(df).first()["lyapunov"] != 0


def test_phrases_by_definition():
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    s = "".join("1" if v else "0" for v in x > np.median(x))
    phrases, at = 0, 0
    while at < len(s):
        size = 1
        while at + size <= len(s) and s[at : at + size] in s[: at + size - 1]:
            size += 1
        phrases, at = phrases + 1, at + size
    assert waveform.lz76(x) == pytest.approx(min(phrases / (400 / (np.log2(400) + 1)), 1))
