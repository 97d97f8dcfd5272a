"""Boosting grown leaf by leaf, against a plain version that looks at one split at a time."""

import heapq
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from skysift.operators import leafwise


def plain(b, g, h, bins, leaves, least, rate):
    """What a tree gives to every row: lists, one split at a time."""

    def best(at):
        found = (leafwise.LEAST_GAIN, None, None)
        gs, hs = sum(g[i] for i in at), sum(h[i] for i in at)
        for f in range(len(b[0])):
            for cut in range(bins):
                left = [i for i in at if b[i][f] <= cut]
                right = [i for i in at if b[i][f] > cut]
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                if min(len(left), len(right)) < least or min(hl, hs - hl) < 1e-3:
                    continue
                gain = round(gl**2 / hl + (gs - gl) ** 2 / (hs - hl) - gs**2 / hs, 9)
                if gain > found[0]:
                    found = (gain, f, cut)
        return found

    ends, heap = [], []

    def opened(at):
        gain, f, cut = best(at)
        if f is None:
            ends.append(at)
        else:
            heapq.heappush(heap, (-gain, at, f, cut))

    opened(list(range(len(b))))
    while heap and len(ends) + len(heap) < leaves:
        _, at, f, cut = heapq.heappop(heap)
        opened([i for i in at if b[i][f] <= cut])
        opened([i for i in at if b[i][f] > cut])
    out = [0.0] * len(b)
    for at in ends + [x[1] for x in heap]:
        for i in at:
            out[i] = -rate * sum(g[j] for j in at) / sum(h[j] for j in at)
    return out


@pytest.mark.parametrize(("leaves", "held"), [(2, 1 << 17), (7, 1 << 17), (31, 64)])
def test_trees_equal_a_plain_version(leaves, held, monkeypatch):
    monkeypatch.setattr(leafwise, "HELD", held)
    rng = np.random.default_rng(2)
    b = rng.integers(0, 12, (150, 3)).astype(np.uint8)
    g, h = rng.normal(0, 1, (4, 150)), rng.uniform(0.05, 0.25, (4, 150))
    trees, step = leafwise.grow(b, (b + np.arange(3) * 12).astype(np.uint16), g, h, 12, leaves, 5)
    for t, tree in enumerate(trees):
        assert step[t] == pytest.approx(plain(b.tolist(), g[t].tolist(), h[t].tolist(), 12, leaves, 5, 0.1), abs=1e-9)
        assert np.array(tree.value)[tree.place(b)] == pytest.approx(step[t], abs=1e-12)
        assert sum(f < 0 for f in tree.feature) <= leaves


def test_bins_of_few_and_of_many_values():
    assert leafwise.thresholds(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5]
    x = np.random.default_rng(1).normal(0, 1, 5000)
    rows = np.bincount(np.searchsorted(leafwise.thresholds(x), x))
    assert len(rows) == leafwise.BINS and rows.min() >= 19 and rows.max() <= 21
    assert leafwise.thresholds(np.array([4.0])).tolist() == []


def test_medians_of_the_training_rows_fill_what_is_missing():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (900, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)
    train = np.arange(900) % 5 != 0
    for k, bad in enumerate((np.nan, np.inf, -np.inf)):
        x[k::11, k] = bad
    by_hand = np.array([np.median(c[np.isfinite(c) & train]) for c in x.T])
    none = np.zeros(900, bool)
    got, _ = leafwise.fit_predict(x, y, train, none, 3, 8)
    want, _ = leafwise.fit_predict(np.where(np.isfinite(x), x, by_hand), y, train, none, 3, 8)
    assert (got == want).all() and (got == y[~train]).mean() > 0.8
    assert leafwise.medians(np.array([[np.nan]])).tolist() == [0.0]


def test_rounds_end_early_only_with_many_rows(monkeypatch):
    rng = np.random.default_rng(5)
    x, noise = rng.normal(0, 1, (900, 2)), rng.integers(0, 3, 900)
    train, tenth = np.arange(900) % 3 != 0, np.arange(900) % 10 == 1
    assert leafwise.fit_predict(x, noise, train, tenth, 3, 25)[1] == 25
    monkeypatch.setattr(leafwise, "MANY", 500)
    assert leafwise.WAIT <= leafwise.fit_predict(x, noise, train, tenth, 3, 40)[1] < 40
    assert leafwise.fit_predict(x, (x[:, 0] > 0).astype(int), train, tenth, 2, 25)[1] == 25  # its loss falls on
    assert not leafwise.halt([1.0] * 10) and leafwise.halt([1.0] * 11) and not leafwise.halt([1.0] * 10 + [0.9])


def embeddings(folder, rows):
    kinds = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])
    pq.write_table(pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds), folder / "embeddings.parquet")
    return str(folder)


def test_population_boosting_learns_what_takes_three_levels(spark, tmp_path):
    from skysift.jobs import model_queries

    rng = random.Random(6)
    x = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(3000)]
    path = embeddings(tmp_path, [(i, v, int(v[0] * v[1] * v[2] > 0)) for i, v in enumerate(x)])
    rows = {r["model"]: r for r in model_queries.population_boosting(spark, path, 40, 3).collect()}
    assert rows["boosted"]["mcc"] > 0.8 and rows["boosted"]["n"] == 3000  # trees of depth 2: about 0


def test_population_boosting_takes_rows_with_missing_values(spark, tmp_path):
    from skysift.jobs import model_queries

    rng = random.Random(7)
    rows = []
    for i in range(300):
        v = [rng.gauss(0, 1) for _ in range(8)]
        code = [5, 200, None][(v[0] > 0.4) + (v[0] > 1.2)]
        if i % 9 == 0:
            v[1 + i % 7] = [None, float("nan"), float("inf")][i % 3]
        rows.append((i // 2 * 2, v if i % 50 else None, code))  # ids come twice
    out = {r["model"]: r for r in model_queries.population_boosting(spark, embeddings(tmp_path, rows), 10, 3).collect()}
    assert all(r["n"] == 300 and r["accuracy"] > 0.8 for r in out.values())
    none = {r["model"]: r["n"] for r in model_queries.population_boosting(spark, embeddings(tmp_path, []), 2, 3).collect()}
    assert set(none) == {"boosted", "forest"} and not any(none.values())


def test_medians_of_the_other_folds(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    from skysift.operators import models

    rng = random.Random(8)
    data = []
    for i in range(240):
        a, b = rng.gauss(0, 1) + 5 * (i % 3), rng.gauss(0, 1)
        data.append((i, float("nan") if i % 7 == 0 else a, None if i % 5 == 0 else b, int(a + b > 5), i % 3))
    df = spark.createDataFrame(data, "id long, a double, b double, y int, fold int")
    tree = DecisionTreeClassifier(labelCol="y", maxDepth=4)
    got = sorted(map(tuple, models.imputed_out_of_fold(df, tree, "y", "fold", ("a", "b"), [0, 1, 2]).collect()))
    want = []
    for k in range(3):
        med = [float(np.median([r[c] for r in data if r[4] != k and r[c] is not None and r[c] == r[c]])) for c in (1, 2)]
        hand = [(*r[:1], *[m if v is None or v != v else v for v, m in zip(r[1:3], med, strict=True)], *r[3:]) for r in data]
        whole = spark.createDataFrame(hand, df.schema)
        part = models.imputed_out_of_fold(whole.where(F.lit(True)), tree, "y", "fold", ("a", "b"), [k])
        want += map(tuple, part.collect())
    assert got == sorted(want)


def test_no_fitted_model_waits_in_the_plan(spark, tmp_path):
    from skysift.jobs import model_queries

    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 2) for i in range(60)]
    plan = model_queries.population_boosting(spark, embeddings(tmp_path, rows), 2, 3)._jdf.queryExecution().analyzed().toString()
    # five forests in one plan were more than the driver's heap could serialise
    assert "UDF" not in plan and "MapInArrow" not in plan and "Relation" in plan
