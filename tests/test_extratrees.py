"""Extremely randomised trees against growing one node at a time."""


import numpy as np
import pytest

from skysift.operators import boosting, extratrees
from tests.test_boosting import COLUMNS, made


@pytest.fixture(scope="module")
def rows():
    return made(300, 11)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, fold int").repartition(3)


def gini_gain(y, go, classes):
    def pure(v):
        return sum((v == c).sum() ** 2 for c in range(classes)) / max(len(v), 1)

    return pure(y[go]) + pure(y[~go]) - pure(y)


def test_splits_and_leaves_equal_a_plain_version(table, rows):
    depth, least = 3, 4
    held, trees = extratrees.fit(table, "y", "fold", COLUMNS, 3, np.array([[1, 1, 0], [0, 1, 1]]), 3, depth, least, keep=("id",))
    b = {r["id"]: list(r["_b"]) for r in held.collect()}
    y = {r[0]: r[4] for r in rows}
    for t in range(6):
        use = {0, 1} if t < 3 else {1, 2}
        at = {0: np.array([r[0] for r in rows if r[5] in use])}
        lo, hi = {0: [0] * 3}, {0: [boosting.BINS] * 3}
        for level in range(depth):
            first, n = (1 << level) - 1, 1 << level
            bounds = [np.zeros((6, n, 3), int), np.zeros((6, n, 3), int)]
            for k in range(n):
                bounds[0][t, k], bounds[1][t, k] = lo[first + k], hi[first + k]
            cuts = extratrees.drawn(extratrees.SEED, level, *bounds)[t]
            for k in range(n):
                ids, node = at[first + k], first + k
                ys, best = np.array([y[i] for i in ids]), (1e-9, -1)
                for f in range(3):
                    go = np.array([b[i][f] <= cuts[k, f] for i in ids], bool)
                    if min(go.sum(), (~go).sum()) >= least:
                        g = round(gini_gain(ys, go, 3), 9)
                        best = (g, f) if g > best[0] else best
                assert trees.feature[t, node] == best[1]
                if len(ys):
                    assert trees.share[t, node] == pytest.approx([(ys == c).mean() for c in range(3)])
                f = max(best[1], 0)
                go = np.array([b[i][f] <= cuts[k, f] for i in ids], bool)
                for side, pick in ((1, go), (2, ~go)):
                    at[2 * node + side] = ids[pick] if best[1] >= 0 else ids[:0]
                    lo[2 * node + side], hi[2 * node + side] = list(lo[node]), list(hi[node])
                if best[1] >= 0:
                    hi[2 * node + 1][f], lo[2 * node + 2][f] = int(cuts[k, f]), int(cuts[k, f]) + 1
        for node in range((1 << depth) - 1, (2 << depth) - 1):
            if len(at[node]):
                assert trees.share[t, node] == pytest.approx([np.mean([y[i] == c for i in at[node]]) for c in range(3)])


def test_out_of_fold(table, rows):
    got = {r["id"]: r for r in extratrees.out_of_fold(table, "y", "fold", COLUMNS, 3, 3, ("id",), n_trees=15, depth=6).collect()}
    assert len(got) == len(rows) and all(sum(r["probability"]) == pytest.approx(1) for r in got.values())
    assert sum(got[r[0]]["prediction"] == r[4] for r in rows) > 0.75 * len(rows)
    again = {r["id"]: r["prediction"] for r in extratrees.out_of_fold(table, "y", "fold", COLUMNS, 3, 3, ("id",), n_trees=15, depth=6).collect()}
    assert again == {i: r["prediction"] for i, r in got.items()}


def test_no_rows(table):
    assert extratrees.out_of_fold(table.where("id < 0"), "y", "fold", COLUMNS, 3, 3, ("id",), n_trees=2, depth=2).count() == 0
