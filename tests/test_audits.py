"""The audits that have no SQL twin, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.jobs import audit_queries as Q
from skysift.operators import metrics, models, persist, splits
from skysift.session import stored
from skysift.sources import adapters as A

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    """What the audit reads, over a part of the survey that fits quickly."""
    sig, waves, spectra, survey = Q.measured(spark, SF)
    return sig, waves, stored(spectra), survey


def _plain_p(null, scores, low):
    return [(1 + sum(n <= x if low else n >= x for n in null)) / (1 + len(null)) for x in scores]


def test_audit_evidence(spark, inputs):
    """Both p-values, their fusion, the anomaly's probability and the verdict's
    first rule, against plain counting."""
    sig, waves, spectra, survey = inputs
    rows = stored(Q.audited(*inputs, rounds=2, folds=2, epochs=2)).toPandas()
    assert len(rows) == sig.count() and rows["signal_id"].is_unique
    null = rows.loc[rows["true_role"].isin(["Natural", "Interference"]), "narrowband"].round(6)
    assert np.allclose(rows["p_d"], _plain_p(null, rows["narrowband"].round(6), low=False))
    split = stored(splits.fit_calibration(survey, "vec_id", "y", 0.75))
    mix = models.fit_mixtures(split.where("is_fit = 1"), "y", A.SURVEY, 5)
    cal = models.log_prob(split.where("is_fit = 0"), mix).toPandas()
    own = models.log_prob(Q.on_survey(sig, split), mix).toPandas().set_index("signal_id")
    for r in rows.itertuples():
        one = own.loc[r.signal_id]
        k = 1 if round(one["log_prob_1"], 6) >= round(one["log_prob_0"], 6) else 0
        (want,) = _plain_p(cal[f"log_prob_{k}"].round(6), [round(one[f"log_prob_{k}"], 6)], low=True)
        assert r.p_h == pytest.approx(want)
        assert r.p_fused == pytest.approx(min(1, 2 * r.p_h, 2 * r.p_d)) and r.m2 == pytest.approx(1 - r.p_fused)
        g = np.sqrt(np.maximum(np.array([r.m0, r.m1, r.m2]) * np.array([r.q0, r.q1, r.q2]), 1e-12))
        assert [r.p0, r.p1, r.p2] == pytest.approx(list(g / g.sum()))
        assert r.pred == int(np.argmax([r.m0, r.m1, r.m2]))
    assert (rows.loc[rows["ood_mask"] | (rows["p"] < 0.05), "verdict"] == "Anomaly").all()


def test_roles_and_waves_matter(spark):
    """Permuted roles move the rates; other waves move what the network says; a
    signal's own waves and role never reach the network that scores it."""
    sig, waves, spectra, survey = inputs = Q.measured(spark, "/root/testdata/sf0.01")
    ev = lambda s, w: {r["signal_id"]: (r["q0"], r["q1"], r["q2"]) for r in Q.wave_evidence(s, w, 2, 2).collect()}
    before = ev(sig, waves)
    fold = {r["signal_id"]: r["fold"] for r in Q.wave_scores(sig, waves, 2, 1).select("signal_id", "fold").distinct().collect()}
    shown = stored(Q.audited(*inputs, rounds=2, folds=2, epochs=2))
    ids = [r[0] for r in sig.select("signal_id").orderBy("signal_id").collect()]
    turned = spark.createDataFrame(list(zip(ids, ids[1:] + ids[:1], strict=True)), "signal_id long, other long")
    roles = sig.select(F.col("signal_id").alias("other"), F.col("true_role").alias("r")).join(turned, "other").select("signal_id", "r")
    permuted = metrics.role_rates(shown.join(roles, "signal_id").withColumn("true_role", F.col("r"))).first()
    as_given = metrics.role_rates(shown).first()
    assert (permuted["tpr"], permuted["fpr"]) != (as_given["tpr"], as_given["fpr"])
    assert 0 < as_given["fpr"] < 1 and as_given["tpr"] < 1
    one = next(i for i in ids if fold[i] == 0)
    flipped = F.when(F.col("signal_id") == one, F.transform("wave", lambda x: -3 * x)).otherwise(F.col("wave"))
    after = ev(sig.withColumn("true_role", F.when(F.col("signal_id") == one, "Anomaly").otherwise(F.col("true_role"))), waves.withColumn("wave", flipped))
    same = [i for i in ids if fold[i] == 0 and i != one]
    assert before[one] != pytest.approx(after[one])
    assert all(before[i] == pytest.approx(after[i]) for i in same)  # the same network scored them


def test_signals_without_waves_are_neutral(spark, inputs):
    sig, waves, _, _ = inputs
    none = Q.wave_evidence(sig, waves.withColumn("wave", F.array(F.lit(0.0))), 2, 1).collect()
    assert len(none) == sig.count() and all((r["n_waves"], r["q0"], r["q1"], r["q2"]) == (0, 1 / 3, 1 / 3, 1 / 3) for r in none)


def test_cross_conformal_gate(spark):
    r = Q.manifold_cross_conformal(spark, SF, 3).first()
    n = r["n_neg"]
    assert r["n_pos"] > 0 and n > 6
    assert r["fpr"] <= 0.1 + 2 / n and r["coverage"] >= 0.9 - 2 / n and 0 <= r["auroc"] <= 1


def test_waveform_classes(spark):
    rows = Q.waveform_classes(spark, SF, 2, 2).toPandas()
    assert np.allclose(rows[["p0", "p1", "p2"]].sum(axis=1), 1, atol=1e-5)
    e = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id", "(day(ts) - 1) * 4 + hour(ts) div 6 AS bin", "value").toPandas()
    filled = e.groupby(["user_id", "bin"])["value"].sum().reset_index()
    filled["window"] = filled["bin"] // 32
    want = {k for k, n in filled.groupby(["user_id", "window"]).size().items() if n > 1}
    assert set(zip(rows["signal_id"], rows["window"], strict=True)) == want and len(rows) == len(want)
    wave = {(r["signal_id"], r["window"]): r["wave"] for r in A.audit_waves(spark, SF).collect()}
    for r in filled.sample(60, random_state=1).itertuples():
        if (r.user_id, r.window) in want:
            assert wave[(r.user_id, r.window)][r.bin % 32] == pytest.approx(r.value)


def test_ensemble_is_saved_and_loaded(spark, tmp_path):
    v = A.survey(spark, SF)
    model = models.ensemble_pipeline("y", A.SURVEY, 3).fit(v)
    persist.save_ensemble(model, str(tmp_path / "m"))
    again = persist.load_ensemble(str(tmp_path / "m"))
    a, b = ([r["prediction"] for r in m.transform(v).orderBy("vec_id").collect()] for m in (model, again))
    assert a == b
