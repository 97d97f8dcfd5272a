"""Every core query runs, and has the rows of its SQL twin."""

import duckdb
import pytest

from skysift.jobs import registry
from skysift.operators import rank

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None:
        return "None"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


MANY_RANGES = ("bh_fdr", "auroc_mann_whitney", "conformal_class_conditional", "stratified_kfold", "fit_calibration_split", "score_histogram", "standardize_pop")


@pytest.mark.parametrize("name", MANY_RANGES)
def test_equals_sql_over_many_ranges(spark, con, name, monkeypatch):
    monkeypatch.setattr(rank, "RANGE_ROWS", 90)
    test_equals_sql(spark, con, name)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, name):
    a = registry.queries()[name](spark, SF)
    b = con.execute(registry.oracle_sql()[name])
    cols = sorted(a.columns)
    names = [d[0] for d in b.description]
    assert cols == sorted(names)
    left = sorted([_plain(r[c]) for c in cols] for r in a.collect())
    right = sorted([_plain(r[names.index(c)]) for c in cols] for r in b.fetchall())
    assert len(left) == len(right)
    bad = [(x, y) for x, y in zip(left, right, strict=True) if x != y]
    assert not bad, (len(bad), bad[:3])
