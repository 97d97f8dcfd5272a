"""Bootstraps against plain sums over the same weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.operators import conformal, resample


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    data = [(i, float(round(rng.normal(i % 2, 1), 1)), i % 2) for i in range(900)]
    return spark.createDataFrame(data, "id long, s double, y int")


def plain_weights(rows, replicates):
    h = {r["id"]: r["h"] for r in rows.select("id", F.xxhash64("id", F.lit(resample.SEED)).alias("h")).collect()}
    w = resample.weights(np.array([h[r["id"]] for r in rows.orderBy("id").select("id").collect()], np.int64), replicates)
    data = rows.orderBy("id").toPandas()
    return w, data["s"].to_numpy(), data["y"].to_numpy()


def test_weights_are_poisson():
    w = resample.weights(np.arange(4000, dtype=np.int64), 50)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:].mean() - 1) < 0.01 and abs(w[:, 1:].var() - 1) < 0.02
    assert abs(np.corrcoef(w[:, 1], w[:, 2])[0, 1]) < 0.05 and abs(np.corrcoef(w[:-1, 3], w[1:, 3])[0, 1]) < 0.05


def test_mean(rows, monkeypatch):
    monkeypatch.setattr(resample, "HELD", 5000)
    w, s, _ = plain_weights(rows, 200)
    got = resample.mean(rows.repartition(5), "s", "id", 200).first()
    m = (w * s[:, None]).sum(axis=0)[1:] / w.sum(axis=0)[1:]
    assert got["n"] == 900 and got["mean"] == pytest.approx(s.mean())
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.percentile(m, [2.5, 97.5])))
    assert abs((got["high"] - got["low"]) / (2 * 1.96 * s.std() / 30) - 1) < 0.15  # as wide as theory says


@pytest.mark.parametrize("partitions", [1, 6])
def test_auroc(spark, rows, monkeypatch, partitions):
    monkeypatch.setattr(resample, "HELD", 5000)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = resample.auroc(rows, "s", "y", "id", 60).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    w, s, y = plain_weights(rows, 60)
    wins = (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
    area = [a @ wins @ b / (a.sum() * b.sum()) for a, b in zip(w[y == 1].T, w[y == 0].T, strict=True)]
    assert got["n"] == 900 and got["auroc"] == pytest.approx(area[0]) == pytest.approx(conformal.auroc(rows, "s", "y").first()["auroc"])
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.percentile(area[1:], [2.5, 97.5])))


def test_few_rows(rows):
    none = resample.mean(rows.where("id < 0"), "s", "id", 20).first()
    assert (none["n"], none["mean"], none["low"]) == (0, None, None)
    one = resample.mean(rows.where("id = 3"), "s", "id", 20).first()
    assert one["n"] == 1 and one["low"] is None and one["mean"] is not None
    assert tuple(resample.auroc(rows.where("id < 0"), "s", "y", "id", 20).first()) == (0, None, None, None)
    assert resample.auroc(rows.where("y = 1"), "s", "y", "id", 20).first()["auroc"] is None
