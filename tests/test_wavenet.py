"""The waveform network: gradients, learning, placeholders, save and load."""

import numpy as np
from pyspark.sql import functions as F

from skysift.operators import wavenet as N


def test_gradient_equals_differences():
    r = np.random.default_rng(0)
    size = sum(int(np.prod(s)) for s in N.shapes(16).values())
    w, x, y = r.standard_normal(size) * 0.3, r.standard_normal((5, 16)), np.array([0, 1, 2, 1, 0])

    def loss(v):
        p = N._split(v, 16)
        return -np.log(N.forward(p, x)[0][np.arange(5), y]).mean() + 0.005 * sum((a**2).sum() for a in p.values() if a.ndim > 1)

    g = N.gradient(N._split(w, 16), x, y, 0.01)
    for i in r.choice(size, 60, replace=False):
        e = np.zeros(size)
        e[i] = 1e-6
        assert abs((loss(w + e) - loss(w - e)) / 2e-6 - g[i]) < 1e-5


def _waves(spark, monkeypatch, shard):
    """Square waves, sparse clicks of either sign, and ramps that fall back."""
    monkeypatch.setattr(N, "SHARD", shard)
    r, rows = np.random.default_rng(17), []
    for i in range(120):
        kind = i % 3
        if kind == 0:
            x = np.repeat(np.tile([1.0, -1.0], 16), 8) * r.uniform(0.8, 1.2)
        elif kind == 1:
            x = np.where(r.random(256) < 0.06, r.choice([-3.0, 3.0], 256), 0.0)
        else:
            x = (np.arange(256) % 32) / 16.0 - 1.0
        rows.append((i, (x + 0.1 * r.uniform(-1, 1, 256)).tolist(), kind))
    return spark.createDataFrame(rows, "id long, x array<double>, y int")


def test_learns_in_shards_and_is_deterministic(spark, monkeypatch, tmp_path):
    df = _waves(spark, monkeypatch, 48)
    train, test = df.where("id % 5 > 0"), df.where("id % 5 = 0")
    net, again = (N.WaveNet.fit(train, "id", "x", "y", epochs=12, batch=8) for _ in range(2))
    assert np.allclose(net.weights, again.weights)
    net.save(spark, str(tmp_path / "net"))
    loaded = N.WaveNet.load(spark, str(tmp_path / "net"))
    got = test.select("y", loaded.probabilities("x").alias("p")).select("y", (F.array_position("p", F.array_max("p")) - 1).alias("c"), "p").collect()
    assert np.mean([r["y"] == r["c"] for r in got]) > 0.7
    assert all(abs(sum(r["p"]) - 1) < 1e-9 for r in got)


def test_placeholders_and_untrained(spark, monkeypatch):
    df = _waves(spark, monkeypatch, 4096).limit(5)
    net = N.WaveNet.fit(df, "id", "x", "y")
    assert net.weights is None
    odd = spark.createDataFrame([(1, [0.0]), (2, None), (3, [float("nan")] * 256), (4, [])], "id long, x array<double>")
    net.weights = np.zeros(sum(int(np.prod(s)) for s in N.shapes(256).values()))
    for r in odd.select(net.probabilities("x").alias("p")).collect():
        assert np.allclose(r["p"], 1 / 3)
