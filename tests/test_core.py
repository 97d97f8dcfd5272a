"""Signal operators on small inputs against plain NumPy or fixed answers."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.functions import laws, physical
from skysift.jobs import report
from skysift.operators import catalogs, conformal, fusion, metrics, models, splits, waterfall, waveform
from skysift.operators.rank import cumulative
from skysift.sources import filterbank, files


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(1)
    rows = [(i, "ab"[i % 2], round(rng.gauss(0, 1), 1), int(i % 3 == 0)) for i in range(300)]
    return spark.createDataFrame(rows, "id long, class_name string, score double, is_cal int")


def test_cumulative_with_ties(scores):
    rows = cumulative(scores.withColumn("one", F.lit(1)), "score", {"n": "one"}, ("class_name",)).collect()
    for r in rows:
        assert r["n"] == sum(x["class_name"] == r["class_name"] and x["score"] <= r["score"] for x in rows)


def test_conformal_low_tail(scores):
    rows = conformal.low_tail(scores).collect()
    cal = [r["score"] for r in rows if r["is_cal"]]
    for r in rows:
        assert r["p"] == pytest.approx((1 + sum(c <= r["score"] for c in cal)) / (1 + len(cal)))
        assert 0 < r["p"] <= 1


def test_thresholds_and_loo(scores):
    x = sorted(r["score"] for r in scores.collect())
    n, alpha = len(x), 0.1
    k = min(max(math.ceil((1 - alpha) * (n + 1)) - 1, 0), n - 1)
    assert conformal.thresholds(scores, alpha).first()["threshold"] == x[k]
    flagged = 0
    for i in range(n):
        rest = x[:i] + x[i + 1 :]
        k = min(max(math.ceil((1 - alpha) * n) - 1, 0), n - 2)
        flagged += x[i] > rest[k]
    assert conformal.loo_flag_rate(scores, alpha).first()["flagged"] == flagged


def test_bh(spark):
    rng = random.Random(2)
    p = [round(rng.random() ** 3, 2) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(p)), "id long, p double")
    got = {r["id"]: r["rejected"] for r in conformal.bh(df, 0.1).collect()}
    s = sorted(p)
    cut = max((s[k] for k in range(200) if s[k] * 200 <= 0.1 * (k + 1)), default=-1)
    assert got == {i: v <= cut for i, v in enumerate(p)}
    assert conformal.bh(df.where("id < 0"), 0.1).count() == 0


@pytest.mark.parametrize(("neg", "pos", "want"), [([1, 2], [3, 4], 1.0), ([1, 1], [1, 1], 0.5), ([3, 4], [1, 2], 0.0)])
def test_auroc(spark, neg, pos, want):
    df = spark.createDataFrame([(float(x), 0) for x in neg] + [(float(x), 1) for x in pos], "score double, y int")
    assert conformal.auroc(df).first()["auroc"] == want


def test_metrics(spark):
    t = [0, 0, 1, 1, 2, 2, 2, 0]
    p = [0, 1, 1, 1, 2, 0, 2, 0]
    df = spark.createDataFrame(list(zip(t, p, strict=True)), "t int, p int")
    m = metrics.multiclass(df).first()
    assert m["accuracy"] == 6 / 8
    c = np.zeros((3, 3))
    np.add.at(c, (t, p), 1)
    s, k, tk, pk = c.sum(), np.trace(c), c.sum(1), c.sum(0)
    assert m["mcc"] == pytest.approx((k * s - tk @ pk) / math.sqrt((s * s - pk @ pk) * (s * s - tk @ tk)))
    assert metrics.chi2_1_tail(3.841458820694124) == pytest.approx(0.05)


def test_role_rates_without_rows(spark):
    df = spark.createDataFrame([("Unlabeled", "Anomaly")], "true_role string, verdict string")
    r = metrics.role_rates(df).first()
    assert (r["tpr"], r["fpr"], r["passed"]) == (1.0, 0.0, True)


def test_laws_at_their_bounds(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    lit = F.lit
    none = lit(None).cast("double")
    assert one(laws.dispersion_excess(lit(10.0), lit(20.0), lit(True))) == 0.0
    assert one(laws.dispersion_excess(lit(30.0), none, lit(True))) == 0.5
    assert one(laws.duty_cycle(lit(0.0), lit(1.0))) == 0.5
    assert one(laws.duty_cycle(lit(100.0), lit(1.0))) == 1.0
    assert one(laws.technosignature(none, none, lit(False))) == 0.0
    assert one(laws.technosignature(lit(1.0), lit(0.0), lit(True))) == 1.0
    assert one(physical.snr_to_moment(none, 2.0, 4.0)) == 3.0
    assert one(physical.snr_to_moment(lit(10.0), 2.0, 4.0)) == pytest.approx(3.0)
    assert one(physical.snr_to_moment(lit(1e9), 2.0, 4.0)) == pytest.approx(4.0)


CATALOG = "object_id long, class_name string, dm double, dm_gal_max double, snr double, width_ms double, period_s double, glat double"


def test_featurize(spark):
    df = spark.createDataFrame([(1, "P", 50.0, 40.0, None, 5.0, 0.5, -12.0), (2, "F", 500.0, None, 9.0, 2.0, None, 3.0), (3, "R", 0.0, 10.0, 0.0, None, None, None)], CATALOG)
    catalogs.check(df)
    f = {r["object_id"]: r for r in catalogs.featurize(df).collect()}
    assert f[1]["log_duty"] == pytest.approx(math.log10(0.005 / 0.5)) and f[1]["has_snr"] == 0
    assert f[2]["dm_excess"] == 0 and f[2]["log_period"] is None and f[3]["log_width"] is None
    m = catalogs.medians(catalogs.featurize(df)).first()
    assert m["log_period"] == pytest.approx(math.log10(0.5))
    for bad in (df.where("object_id < 0"), df.drop("snr"), df.withColumn("dm", F.lit(-1.0)), df.withColumn("dm", F.lit(None).cast("double"))):
        with pytest.raises(catalogs.CatalogError):
            catalogs.check(bad)


def test_splits_are_stratified_and_stable(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    a, b = (splits.stratified(df.repartition(n), "id", "y") for n in (2, 7))
    assert sorted(a.select("id", "split").collect()) == sorted(b.select("id", "split").collect())
    assert {(r["y"], r["split"]): r["count"] for r in a.groupBy("y", "split").count().collect()}[1, "train"] == 80
    folds = splits.kfold(df, "id", "y", 5).groupBy("y", "fold").count().collect()
    assert {r["count"] for r in folds if r["y"] == 1} == {20}
    g = splits.group_kfold(df.withColumn("g", F.col("id") % 50), "g", "y", 4)
    assert g.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


SIGNAL = "signal_id long, p0 double, p1 double, p2 double, p_h double, p_d double, chaos double, concentration double, spectral_flatness double, dm double, dm_gal_max double, width_ms double, period_s double, is_extragalactic boolean, ood_mask boolean"


def test_verdict_precedence(spark):
    rows = [
        (1, 0.9, 0.05, 0.05, 0.9, None, None, 0.0, 1.0, None, None, None, None, False, True),
        (2, 0.9, 0.05, 0.05, 0.01, None, None, 0.0, 1.0, None, None, None, None, False, False),
        (3, 0.9, 0.05, 0.05, 0.9, None, None, 0.0, 1.0, None, None, None, None, False, False),
        (4, 0.05, 0.9, 0.05, 0.9, None, None, 0.0, 1.0, None, None, None, None, False, False),
        (5, 0.9, 0.05, 0.05, 0.9, None, None, 1.0, 0.0, None, None, None, None, False, False),
        (6, 0.3, 0.3, 0.4, 0.9, None, None, 0.0, 1.0, None, None, None, None, False, False),
        (7, 0.3, 0.5, 0.2, 0.9, None, None, 0.0, 1.0, None, None, None, None, False, False),
    ]
    got = {r["signal_id"]: r["verdict"] for r in fusion.arbitrate(spark.createDataFrame(rows, SIGNAL)).collect()}
    assert got == {1: "Anomaly", 2: "Anomaly", 3: "Natural", 4: "Interference", 5: fusion.CANDIDATE, 6: fusion.CANDIDATE, 7: "Interference"}


@pytest.fixture(scope="module")
def pulse(spark):
    rng = np.random.default_rng(3)
    n_t, n_c, dm, ts = 128, 32, 60.0, 0.001
    f = 1500 - 4.0 * np.arange(n_c)
    x = rng.normal(0, 1, (n_t, n_c))
    shift = np.rint(waterfall.K_DM * dm * (f**-2 - f[0] ** -2) / ts).astype(int)
    for c in range(n_c):
        x[20 + shift[c], c] += 15
    return spark.createDataFrame([("o", t, c, float(f[c]), float(x[t, c])) for t in range(n_t) for c in range(n_c)], "obs_id string, t int, ch int, freq_mhz double, power double")


def test_dispersed_pulse_is_recovered(pulse):
    best = waterfall.dm_best(waterfall.dm_sweep(pulse, 0.001, 100.0, 51)).first()
    assert abs(best["best_dm"] - 60) <= 4 and best["dm0_peak_ratio"] < 0.8


def test_repair_and_dead_channel(pulse):
    broken = pulse.withColumn("power", F.when((F.col("t") == 5) & (F.col("ch") == 3), float("nan")).when(F.col("ch") == 7, 2.0).otherwise(F.col("power")))
    fixed = waterfall.repair(broken)
    assert fixed.where(F.isnan("power")).count() == 0
    norm = waterfall.normalize_bandpass(fixed)
    assert norm.where("ch = 7 AND norm <> 0").count() == 0


def test_windows(pulse):
    w = waterfall.windows(pulse, "t", 40, 20)
    assert w.select("window_idx").distinct().count() == 5
    assert waterfall.windows(pulse, "ch", 16, 1, 2).select("window_idx").distinct().count() == 2
    assert waterfall.windows(pulse, "t", 1000, 1).count() == 0
    assert waterfall.plan_hash(a=1, b=2) == waterfall.plan_hash(b=2, a=1) and len(waterfall.plan_hash(a=1)) == 16


def test_narrowband_scores_higher_than_broadband(spark):
    rng = np.random.default_rng(4)
    x = rng.random((64, 24))
    tone, wide = x.copy(), x + 8
    tone[:, 10] += 40
    rows = [(k, t, c, 100.0 + c, float(a[t, c])) for k, a in (("tone", tone), ("wide", wide)) for t in range(64) for c in range(24)]
    df = spark.createDataFrame(rows, "obs_id string, t int, ch int, freq_mhz double, power double")
    got = {r["obs_id"]: r["narrowband"] for r in waterfall.narrowband_score(waterfall.descriptors(df)).collect()}
    assert got["tone"] > got["wide"]


def test_waveforms(spark):
    rng = np.random.default_rng(5)
    n = 200
    t = np.arange(n)
    sig = {1: np.sin(t / 3), 2: rng.normal(size=n), 3: np.full(n, 2.0), 4: np.array([1.0])}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in sig.items() for i, v in enumerate(x)], "signal_id long, pos int, x double")
    h = {r["signal_id"]: r["permutation_entropy"] for r in waveform.permutation_entropy(df).collect()}
    assert h[2] > h[1] and h[3] == 0 and h[4] == 0
    d = {r["signal_id"]: r["fractal_dimension"] for r in waveform.higuchi_dimension(df).collect()}
    assert d[2] > 1.8 > d[1] and d[4] == 1.5
    e = {r["signal_id"]: r["entropy"] for r in waveform.shannon_entropy(df).collect()}
    p = np.histogram(sig[2], 128)[0] / n
    assert e[2] == pytest.approx(-(p[p > 0] * np.log2(p[p > 0])).sum() / 7) and e[3] == 0
    s = {r["signal_id"]: r for r in waveform.spectral_features(df).collect()}
    assert s[1]["lz76"] < s[2]["lz76"] and s[3]["lyapunov"] == 0 and s[3]["chaos_p"] == 1
    assert waveform.delay_embedding(df).where("signal_id = 1").count() == n - 8


def test_ledoit_wolf_by_its_definition():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    q, four = x.T @ x, float(((x * x).sum(1) ** 2).sum())
    s = q / 60
    mu = np.trace(s) / 4
    d2 = ((s - mu * np.eye(4)) ** 2).sum() / 4
    b2 = min(d2, sum(((np.outer(v, v) - s) ** 2).sum() for v in x) / 4 / 60**2)
    want = b2 / d2 * mu * np.eye(4) + (1 - b2 / d2) * s
    assert np.allclose(models.ledoit_wolf(60, q, four), want)


def test_detector_separates_clusters(spark):
    rng = np.random.default_rng(7)
    rows = [(i, 0, *map(float, rng.normal(0, 1, 3))) for i in range(80)] + [(100 + i, 1, *map(float, rng.normal(10, 1, 3))) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, c double")
    det = models.Detector.fit(df.where("y = 0"), "y", ("a", "b", "c"))
    m = {r["y"]: r["m"] for r in det.score(df).groupBy("y").agg(F.avg("score").alias("m")).collect()}
    assert m[1] > 5 * m[0]
    mix = models.fit_mixtures(df, "y", ("a", "b", "c"), 1)
    lp = models.log_prob(df, mix)
    assert lp.where("(y = 0) <> (log_prob_0 > log_prob_1)").count() == 0


def _fil(nbits=32):
    word = lambda w: struct.pack("<i", len(w)) + w.encode()
    x = np.arange(12, dtype="<f4" if nbits == 32 else "u1").reshape(4, 3)
    head = word("HEADER_START") + word("nchans") + struct.pack("<i", 3) + word("nbits") + struct.pack("<i", nbits) + word("fch1") + struct.pack("<d", 1400.0)
    head += word("foff") + struct.pack("<d", -1.0) + word("odd_key") + word("value") + word("HEADER_END")
    return head + x.tobytes(), x


@pytest.mark.parametrize("nbits", [8, 32])
def test_filterbank(spark, tmp_path, nbits):
    data, x = _fil(nbits)
    (tmp_path / "a.fil").write_bytes(data)
    rows = filterbank.read(spark, str(tmp_path / "a.fil")).collect()
    assert {(r["t"], r["ch"]): r["power"] for r in rows} == {(t, c): float(x[t, c]) for t in range(4) for c in range(3)}
    assert {r["freq_mhz"] for r in rows} == {1400.0, 1399.0, 1398.0}
    h = filterbank.parse_header(data)
    assert h.fields["odd_key"] == "value"
    with pytest.raises(filterbank.FilterbankError):
        filterbank.parse_header(b"\x0c\0\0\0HEADER_STOP!")


def test_curated_list_and_config(spark, tmp_path):
    cols = ["name", "type", *files.MOMENTS, "true_dm"]
    lines = [",".join(cols), ",".join(["a", "Pulsar", *map(str, files.PLACEHOLDER), "oops"]), ",".join(["b", "FRB", *["1"] * 8, "5.5"]), ",".join(["c", "telemetry", *["1"] * 8, ""])]
    (tmp_path / "c.csv").write_text("\n".join(lines))
    got = {r["name"]: r for r in files.read_curated(spark, str(tmp_path / "c.csv")).collect()}
    assert [got[k]["is_placeholder"] for k in "abc"] == [True, False, True]
    assert got["a"]["true_dm"] == 0.0 and got["b"]["true_dm"] == 5.5
    c = files.Config({"data": {"train_ratio": 0.5}})
    assert c.get("data.train_ratio") == 0.5 and c.get("data.split_seed") == 42 and c.get("no.such", 1) == 1
    assert files.Config().get("data.train_ratio") == 0.8


def test_report_verdict(tmp_path):
    ok = {"skipped": False, "passed": True}
    full = {k: dict(ok) for k in report.SUITES}
    assert report.verdict(full)["validated"]
    assert not report.verdict(full | {"6 manifold": {"skipped": True, "reason": "x"}})["validated"]
    assert not report.verdict({})["validated"]
    assert report.guard(lambda: 1 / 0)["skipped"]
    report.write_reports(full, str(tmp_path))
    assert (tmp_path / "summary.json").exists()


def test_streaming_scores(spark, tmp_path):
    from skysift.streaming import scorer

    cal = spark.createDataFrame([("a", float(i)) for i in range(1000)], "class_name string, score double")
    rows = [(f"2024-01-0{1 + i % 3} 10:00:00", "ab"[i % 2], float(i)) for i in range(60)]
    spark.createDataFrame(rows, "ts string, class_name string, score double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts string, class_name string, score double").parquet(str(tmp_path / "in"))
    out = scorer.verdict_counts(scorer.score(stream, scorer.freeze(cal)), alpha=0.05)
    q = out.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("counts").agg(F.sum("n").alias("n"), F.sum("flagged").alias("f")).first()
    assert got["n"] == 60 and 20 <= got["f"] <= 30


def test_audits_return_all_rows(spark):
    from skysift.jobs import extra_queries, model_queries
    from skysift.sources import adapters

    sf = "/root/testdata/sf0.001"
    got = model_queries.real_catalog_audit(spark, sf)
    assert set(got.columns) == {"id", "class_name", "score", "p_min", "p_max", "assigned"}
    assert got.count() == adapters.catalog(spark, sf).count() > 100
    rows = extra_queries.unclassified_audit(spark, sf, lo=0.0, hi=1.0, rounds=2).collect()
    assert len(rows) == adapters.survey(spark, sf).count() > 50
    assert any(r["p_max"] < 0.05 for r in rows)  # rows that escape both classes stay
