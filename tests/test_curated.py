"""Locked catalogs in one schema, and curated signals on the manifold."""

import hashlib

import numpy as np
import pytest

from skysift.jobs import curated
from skysift.operators import models
from skysift.sources import adapters as A
from skysift.sources import files, locked

SF = "/root/testdata/sf0.001"


def test_catalogs_are_normalised(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("# made\nPSRJ\tDM\tGb\tGl\tW50\tP0\tother\nJ1\t10.5\t-3\t120\t2.5\t0.7\tx\n J2 \t*\t1\t2\tnan\t\ty\n\t1\t1\t1\t1\t1\tz\n")
    (tmp_path / "f.tsv").write_text("TNS\tDM\tSNR\tGLAT\tGLON\tWidth\nFRB1\t500\t12\t40\t100\t0.003\n")
    data = (tmp_path / "p.tsv").read_bytes()
    locks = {"atnf_pulsars": {"sha256": hashlib.sha256(data).hexdigest(), "size_bytes": len(data)}}
    paths = {"atnf_pulsars": str(tmp_path / "p.tsv"), "chime_frb_cat1": str(tmp_path / "f.tsv")}
    got = {r["object_id"]: r for r in locked.load_many(spark, paths, locks).collect()}
    assert set(got) == {"J1", "J2", "FRB1"} and got["J1"]["class_name"] == "pulsar" and got["FRB1"]["source"] == "chime_frb_cat1"
    assert (got["J1"]["dm"], got["J1"]["width_ms"], got["J1"]["period_s"], got["J1"]["snr"]) == (10.5, 2.5, 0.7, None)
    assert (got["J2"]["dm"], got["J2"]["width_ms"], got["J2"]["period_s"]) == (None, None, None)
    assert got["FRB1"]["width_ms"] == pytest.approx(3.0)
    (tmp_path / "p.tsv").write_bytes(data + b"J3\t1\t1\t1\t1\t1\tz\n")
    with pytest.raises(locked.LockError, match="locked"):
        locked.load_many(spark, paths, locks)
    with pytest.raises(locked.LockError):
        locked.load(spark, "chime_frb_cat1", str(tmp_path / "none.tsv"), {"sha256": "0", "size_bytes": 1})
    with pytest.raises(locked.LockError, match="lacks"):
        locked.load(spark, "chime_frb_cat1", str(tmp_path / "p.tsv"))
    with pytest.raises(locked.LockError):
        locked.load_many(spark, {})


def test_from_a_list_to_a_ranked_table(spark, tmp_path):
    survey = A.survey(spark, SF)
    some = survey.limit(6).collect()
    lines = [",".join(["name", "type", *files.MOMENTS])]
    lines += [",".join([f"near{i}", "Pulsar", *[repr(r[c]) for c in A.SURVEY]]) for i, r in enumerate(some)]
    lines += ["far,FRB," + ",".join(["80"] * 8), "far again,FRB," + ",".join(["80"] * 8), "near0 again,Pulsar," + ",".join(repr(some[0][c]) for c in A.SURVEY)]
    (tmp_path / "c.csv").write_text("\n".join(lines))
    rows = files.read_curated(spark, str(tmp_path / "c.csv"))
    fitted = curated.Manifold.fit(survey, A.SURVEY)
    fitted.save(str(tmp_path / "density"))
    manifold = curated.Manifold.load(spark, str(tmp_path / "density"))
    out = curated.audit(rows, manifold, files.MOMENTS)
    got = {r["name"]: r for r in out.collect()}
    assert len(got) == 9
    cal = np.array([r["score"] for r in fitted.calibration.collect()])
    n = survey.count()
    assert len(cal) == n - int(0.7 * n)
    own = {r["name"]: r["log_prob"] for r in models.log_prob(rows.selectExpr("name", *[f"{m} AS {c}" for m, c in zip(files.MOMENTS, A.SURVEY, strict=True)]), fitted.mixtures).collect()}
    order = sorted(round(v, 6) for v in own.values())
    for name, r in got.items():
        assert r["score"] == pytest.approx(own[name], abs=1e-6)
        assert r["p"] == pytest.approx((1 + (cal <= r["score"]).sum()) / (1 + len(cal)))
        assert r["rank"] == 1 + order.index(r["score"])
        assert r["verdict"] == (curated.OFF if r["score"] < fitted.floor - curated.MARGIN else curated.ON)
    assert got["far"]["rank"] == got["far again"]["rank"] == 1 and got["far"]["verdict"] == curated.OFF and got["near0"]["verdict"] == curated.ON
    kinds = {r["kind"]: r for r in curated.by_type(out).collect()}
    assert kinds["frb"]["ood_count"] == 2 and kinds["pulsar"]["n"] == 7
    text = curated.report(out, 3)
    assert "2 of 9 signals" in text and "| 1 | far | frb |" in text and text.count("\n| ") >= 5
    assert curated.audit(rows.where("name = ''"), manifold, files.MOMENTS).count() == 0
