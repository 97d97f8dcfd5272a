"""Splits and ranks over many ranges, and rows of null groups."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skysift.operators import catalogs, conformal, rank, splits

N = 700


@pytest.fixture(scope="module")
def rows(spark):
    label = lambda i: None if i % 9 == 0 else int(i % 10 > 1)
    data = [(i, label(i), float(i % 50), i % 7) for i in range(N)] + [(5, label(5), 5.0, 5)]  # an id twice
    return spark.createDataFrame(data, "id long, y int, x double, g long")


def in_order(rows):
    """Ranks by plain sorting: {label: ids in digest order}."""
    out = {}
    for r in rows.collect():
        out.setdefault(r["y"], []).append((hashlib.md5(f"{r['id']}-42".encode()).hexdigest(), r["id"]))
    return {k: [i for _, i in sorted(v)] for k, v in out.items()}


@pytest.mark.parametrize("size", [1_000_000, 60, 7])
def test_ranks_are_the_same_over_any_ranges(rows, monkeypatch, size):
    monkeypatch.setattr(rank, "RANGE_ROWS", size)
    got = splits.ranked(rows, "id", "y").collect()
    assert len(got) == N + 1
    want = in_order(rows)
    for y, ids in want.items():
        own = sorted((r["_i"], r["id"], r["_n"]) for r in got if r["y"] == y)
        assert [(i, j) for i, j, _ in own] == list(enumerate(ids)) and {n for *_, n in own} == {len(ids)}
    fit = splits.fit_calibration(rows, "id", "y", 0.7).where("is_fit = 1").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in fit} == {y: max(1, int(0.7 * len(ids))) for y, ids in want.items()}
    three = splits.stratified(rows, "id", "y").groupBy("y", "split").count().collect()
    assert {(r["y"], r["split"]): r["count"] for r in three}[None, "train"] == int(0.8 * len(want[None]))
    folds = Counter((r["y"], r["fold"]) for r in splits.kfold(rows, "id", "y", 4).collect())
    assert all(abs(folds[y, a] - len(ids) / 4) < 1 for y, ids in want.items() for a in range(4))


def test_no_task_ranks_a_whole_class(rows, monkeypatch):
    """The ranks' window is over class and range, whatever the class's size."""
    monkeypatch.setattr(rank, "RANGE_ROWS", 20)
    plan = splits.ranked(rows, "id", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" in plan and "windowspecdefinition(y" in plan
    assert all("_range" in line for line in plan.splitlines() if "row_number" in line)


def test_groups_keep_together(rows, monkeypatch):
    monkeypatch.setattr(rank, "RANGE_ROWS", 2)
    nulls = rows.withColumn("g", F.when(F.col("g") > 0, F.col("g"))).where("y IS NOT NULL")
    got = splits.group_kfold(nulls, "g", "y", 3)
    assert got.count() == nulls.count() and all(r["n"] == 1 for r in got.groupBy("g").agg(F.countDistinct("fold").alias("n")).collect())


@pytest.mark.parametrize("size", [1_000_000, 40])
def test_rows_of_null_groups_stay(rows, monkeypatch, size):
    monkeypatch.setattr(rank, "RANGE_ROWS", size)
    z = catalogs.standardize(rows, ("x",), ("y",)).toPandas()
    plain = rows.toPandas()
    assert len(z) == N + 1
    own = plain.loc[plain["y"].isna(), "x"]
    assert sorted(z.loc[z["y"].isna(), "x"].round(9)) == pytest.approx(sorted(((own - own.mean()) / own.std(ddof=0)).round(9)))
    p = conformal.low_tail(rows.withColumn("is_cal", (F.col("id") % 2).cast("int")), "x", by=("y",)).toPandas()
    assert len(p) == N + 1
    for r in p.sample(40, random_state=2).itertuples():
        same = p[(p["y"].isna() if r.y != r.y else p["y"] == r.y) & (p["is_cal"] == 1)]
        assert r.p == pytest.approx((1 + (same["x"] <= r.x).sum()) / (1 + len(same)))
    loo = conformal.leave_one_out(rows, "x", ("y",))
    assert loo.count() == N + 1 and conformal.bh(rows.withColumn("p", F.col("x") / 50), 0.1, "p", ("y",)).count() == N + 1
    q = {(r["y"]): r["q0"] for r in rank.quantiles(rows, ("x",), (0.5,), ("y",)).collect()}
    assert q[None] == pytest.approx(own.median())
