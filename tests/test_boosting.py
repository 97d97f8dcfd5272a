"""Boosting against a plain version that looks at one split at a time."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.operators import boosting

COLUMNS = ("a", "b", "c")


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in COLUMNS]
        y = 2 if x[0] > 0.8 else int(x[1] + 0.3 * rng.gauss(0, 1) > 0)
        if i % 13 == 0:
            x[2] = None
        if i % 17 == 0:
            x[0] = float("nan")
        rows.append((i, *x, y, i % 3))
    return rows


def plain(rows, cuts, train, rounds, depth, rate, l2, least, classes):
    """Probabilities of all rows; trees are dicts, rows are lists."""
    binned = [[0 if v is None or math.isnan(v) else 1 + sum(c < v for c in q) for v, q in zip(r[1:4], cuts, strict=True)] for r in rows]
    y = [r[4] for r in rows]
    share = [max(sum(y[i] == k for i in train), 1e-9) for k in range(classes)]
    raw = [[math.log(s / sum(share)) for s in share] for _ in rows]

    def grow(at, g, h, level):
        tot_g, tot_h = sum(g[i] for i in at), sum(h[i] for i in at)
        best = (1e-9, None, None)
        if level < depth:
            for f in range(len(COLUMNS)):
                for cut in range(boosting.BINS + 1):
                    left = [i for i in at if binned[i][f] <= cut]
                    n_left, gl, hl = len(left), sum(g[i] for i in left), sum(h[i] for i in left)
                    gr, hr = tot_g - gl, tot_h - hl
                    if min(n_left, len(at) - n_left) < least or min(hl, hr) < 1e-3:
                        continue
                    gain = round(gl * gl / (hl + l2) + gr * gr / (hr + l2) - tot_g**2 / (tot_h + l2), 9)
                    if gain > best[0]:
                        best = (gain, f, cut)
        if best[1] is None:
            return -rate * tot_g / (tot_h + l2) if tot_h > 0 else 0.0
        _, f, cut = best
        return f, cut, grow([i for i in at if binned[i][f] <= cut], g, h, level + 1), grow([i for i in at if binned[i][f] > cut], g, h, level + 1)

    def value(tree, b):
        while isinstance(tree, tuple):
            tree = tree[2] if b[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(rounds):
        p = [[math.exp(v) / sum(map(math.exp, r)) for v in r] for r in raw]
        trees = [grow(train, [q[k] - (t == k) for q, t in zip(p, y, strict=True)], [q[k] * (1 - q[k]) for q in p], 0) for k in range(classes)]
        raw = [[v + value(t, b) for v, t in zip(r, trees, strict=True)] for r, b in zip(raw, binned, strict=True)]
    return [[math.exp(v) / sum(map(math.exp, r)) for v in r] for r in raw]


@pytest.fixture(scope="module")
def rows(spark):
    return made(240, 3)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, fold int").repartition(3)


def test_probabilities_equal_a_plain_version(table, rows, monkeypatch):
    monkeypatch.setattr(boosting, "KEEP", 2)  # raw scores are written and read on the way
    got = boosting.out_of_fold(table, "y", "fold", COLUMNS, 3, 3, 5, ("id",), rate=0.3, l2=0.5, least=5, depth=2)
    p = {r["id"]: (r["prediction"], r["probability"]) for r in got.collect()}
    cuts = boosting.cut_points(table, COLUMNS)
    for fold in range(3):
        train = [i for i, r in enumerate(rows) if r[5] != fold]
        want = plain(rows, cuts, train, 5, 2, 0.3, 0.5, 5, 3)
        for i, r in enumerate(rows):
            if r[5] == fold:
                assert p[i][1] == pytest.approx(want[i], abs=1e-9)
                assert p[i][0] == int(np.argmax(want[i]))
    assert sum(p[i][0] == r[4] for i, r in enumerate(rows)) > 0.8 * len(rows)


def test_models_with_their_own_settings_share_a_fit(table):
    plan = boosting.Plan(np.array([[1, 1, 0], [1, 1, 0]]), 3, rate=[0.1, 0.3], l2=[0.0, 1.0], least=5, depth=[1, 3])
    both = boosting.Boosted.fit(table, "y", "fold", COLUMNS, plan, 3, ("id",))
    for k, (rate, l2, depth) in enumerate(((0.1, 0.0, 1), (0.3, 1.0, 3))):
        alone = boosting.Boosted.fit(table, "y", "fold", COLUMNS, boosting.Plan(np.array([[1, 1, 0]]), 3, rate, l2, 5, depth), 3, ("id",))
        a = {r["id"]: r["probability"] for r in both.probabilities([k] * 3).collect()}
        b = {r["id"]: r["probability"] for r in alone.probabilities([0] * 3).collect()}
        assert all(a[i] == pytest.approx(b[i], abs=1e-9) for i in b)
    seen = both.every_prediction().agg(F.sum("n")).first()[0]
    assert seen == 2 * table.count()


def test_a_sample_gives_the_same_trees(table, rows):
    plan = boosting.Plan(np.ones((1, 3), bool), 3, least=5, depth=3)
    far = boosting.Boosted.fit(table, "y", "fold", COLUMNS, plan, 4, ("id",)).trees
    cuts = boosting.cut_points(table, COLUMNS)
    b = table.orderBy("id").select(*[boosting.bin_of(c, q).alias(c) for c, q in zip(COLUMNS, cuts, strict=True)]).collect()
    near = boosting.fit_sample(np.array(b, np.uint8), np.array([r[4] for r in rows]), plan, 4, boosting.BINS + 1)
    for x, y in zip(far.feature + far.bin, near.feature + near.bin, strict=True):
        assert (x == y).all()
    assert np.allclose(np.stack(far.value), np.stack(near.value))


def test_sums_of_many_files_are_added_in_spark(table, monkeypatch):
    plan = boosting.Plan(np.ones((1, 3), bool), 3, least=5, depth=2)
    one = boosting.Boosted.fit(table, "y", "fold", COLUMNS, plan, 2).trees
    monkeypatch.setattr(boosting, "FEW", 0)
    two = boosting.Boosted.fit(table, "y", "fold", COLUMNS, plan, 2).trees
    assert all((a == b).all() for a, b in zip(one.feature + one.bin, two.feature + two.bin, strict=True))


def test_population_beside_the_forest(spark):
    from skysift.jobs import model_queries

    rows = {r["model"]: r for r in model_queries.population_boosting(spark, "/root/testdata/sf0.001", 2, 3).collect()}
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert set(rows) == {"boosted", "forest"} and all(r["n"] == n and -1 <= r["mcc"] <= 1 for r in rows.values())


def test_no_rows_and_one_class(spark, table):
    none = table.where("id < 0")
    got = boosting.out_of_fold(none, "y", "fold", COLUMNS, 3, 3, 1, ("id",))
    assert got.count() == 0
    one = boosting.out_of_fold(table.withColumn("y", F.lit(1)), "y", "fold", COLUMNS, 2, 3, 2, ("id",))
    assert {r["prediction"] for r in one.collect()} == {1}


def test_kernel_features(spark, table):
    from skysift.operators import models

    full = table.where("a IS NOT NULL AND NOT isnan(a) AND c IS NOT NULL").select("id", *COLUMNS)
    rows = models.fourier(full, COLUMNS, 2000, 0.4).orderBy("id").limit(40).toPandas()
    every = full.toPandas()
    x = (rows[list(COLUMNS)].to_numpy() - every[list(COLUMNS)].mean().to_numpy()) / every[list(COLUMNS)].std(ddof=0).to_numpy()
    z = np.stack(rows["kernel"])
    exact = np.exp(-0.4 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 0.1 and np.abs(z @ z.T - exact).mean() < 0.025


def test_nested_search(spark):
    from skysift.jobs import extra_queries
    from skysift.sources import adapters as A

    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (400, 8))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "vec_id long, " + ", ".join(f"{c} double" for c in A.SURVEY) + ", y int")
    rows = extra_queries.nested_search(df, 6, 8).collect()
    assert sorted(r["fold"] for r in rows) == list(range(5)) and len(extra_queries.GRID) == 18
    # a product needs two levels at least: a deep cell is chosen and carries over
    assert all(r["depth"] > 2 and r["inner_mcc"] > 0.3 for r in rows) and np.mean([r["mcc"] for r in rows]) > 0.3
    assert sum(r["tp"] + r["fp"] + r["fn"] + r["tn"] for r in rows) == 400
