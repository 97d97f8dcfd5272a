"""The audits as whole runs: from features over models, p-values and fusion to
verdicts, rates and gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import conformal, fusion, metrics, models, splits
from ..operators import waterfall as WF
from ..operators.wavenet import WaveNet
from ..session import spread, stored
from ..sources import adapters as A
from .extra_queries import mapped_to_survey
from .registry import query

#: Where a carrier without counterpart lies on the survey's axes.
ANCHOR = (10.0, 2.0, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0)
#: Level of the gates, and how far below the fitted rows off the manifold begins.
ALPHA, MARGIN = 0.1, 5.0


def on_survey(sig: DataFrame, survey: DataFrame) -> DataFrame:
    """(signal_id, f1 .. f8): the features of the survey row that stands for the
    signal, or the anchor."""
    rows = survey.select(F.col("vec_id").alias("nearest_id"), *A.SURVEY)
    near = mapped_to_survey(sig, survey).select("signal_id", "nearest_id").join(rows, "nearest_id", "left")
    return near.select("signal_id", *[F.coalesce(c, F.lit(a)).alias(c) for c, a in zip(A.SURVEY, ANCHOR, strict=True)])


def density_evidence(feats: DataFrame, survey: DataFrame) -> DataFrame:
    """(signal_id, p_h, ood_mask): low-tail p of the density under the class that
    fits best, against the densities of unseen survey rows under that same class;
    off the manifold is what lies below the least log density of the fitted rows
    by a margin."""
    fit = survey.where("is_fit = 1")
    mix = models.fit_mixtures(fit, "y", A.SURVEY, 5)
    floor = models.log_prob(fit, mix).agg(F.min("log_prob")).first()[0]
    cal = survey.where("is_fit = 0").select(F.lit(None).cast(feats.schema["signal_id"].dataType).alias("signal_id"), *A.SURVEY, F.lit(1).alias("is_cal"))
    both = models.log_prob(cal.unionByName(feats.withColumn("is_cal", F.lit(0))), mix)
    under = F.array(*[F.struct(F.lit(y).alias("k"), F.round(f"log_prob_{y}", 6).alias("score")) for y in sorted(mix, reverse=True)])
    # a calibration row stands under every class, a signal under its best (the higher of equals)
    best = F.array(F.reduce(F.slice(under, 2, len(mix)), F.element_at(under, 1), lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a)))
    rows = both.select("signal_id", "is_cal", "log_prob", F.explode(F.when(F.col("is_cal") == 1, under).otherwise(best)).alias("u"))
    rows = rows.select("signal_id", "is_cal", "log_prob", F.col("u.k").alias("k"), F.col("u.score").alias("score"))
    scored = conformal.low_tail(rows, by=("k",)).where("is_cal = 0")
    return scored.select("signal_id", F.col("p").alias("p_h"), (F.col("log_prob") < floor - MARGIN).alias("ood_mask"))


def descriptor_evidence(signals: DataFrame) -> DataFrame:
    """(signal_id, p_d): high-tail p of the narrowband score against that of
    natural and interference signals; signals without one are left out."""
    null = F.col("true_role").isin("Natural", "Interference").cast("int")
    rows = signals.where("narrowband IS NOT NULL").select("signal_id", F.round("narrowband", 6).alias("score"), null.alias("is_cal"))
    return conformal.high_tail(rows).select("signal_id", F.col("p").alias("p_d"))


def ensemble_evidence(feats: DataFrame, survey: DataFrame, rounds: int) -> DataFrame:
    """(signal_id, p_pulsar): the boosted ensemble, fitted on the survey."""
    from pyspark.ml.functions import vector_to_array

    model = models.ensemble_pipeline("y", A.SURVEY, rounds).fit(spread(survey))
    return model.transform(feats).select("signal_id", vector_to_array("probability")[1].alias("p_pulsar"))


def wave_scores(signals: DataFrame, waves: DataFrame, folds: int, epochs: int, length: int = A.WAVE) -> DataFrame:
    """(signal_id, window, fold, y, wave, q): the network's probabilities of every
    window that carries a wave, always by a network that was fitted on the
    labelled waves of signals in other folds. y is null for unlabelled signals."""
    label = F.when(F.col("true_role") == "Natural", 0).when(F.col("true_role") == "Interference", 1).when(F.col("true_role") == "Anomaly", 2)
    fold = F.floor(splits.hashed_fraction("signal_id", 5) * folds).cast("int")
    rows = stored(waves.join(signals.select("signal_id", label.alias("y"), fold.alias("fold")), "signal_id").withColumn("id", F.concat_ws("#", "signal_id", "window")))
    each = None
    for k in range(folds):
        net = WaveNet.fit(rows.where((F.col("fold") != k) & F.col("y").isNotNull()), "id", "wave", "y", length, epochs)
        part = rows.where((F.col("fold") == k) & (F.size("wave") == length)).withColumn("q", net.probabilities("wave"))
        each = part if each is None else each.unionByName(part)
    return each.drop("id")


def wave_evidence(signals: DataFrame, waves: DataFrame, folds: int, epochs: int, length: int = A.WAVE) -> DataFrame:
    """(signal_id, n_waves, q0, q1, q2): the mean of the windows' probabilities;
    a signal without any wave has 1/3 for each class."""
    scored = wave_scores(signals, waves, folds, epochs, length)
    mean = scored.groupBy("signal_id").agg(F.count("*").alias("n_waves"), *[F.avg(F.col("q")[i]).alias(f"q{i}") for i in range(3)])
    found = signals.select("signal_id").join(mean, "signal_id", "left")
    return found.select("signal_id", F.coalesce("n_waves", F.lit(0)).alias("n_waves"), *[F.coalesce(f"q{i}", F.lit(1 / 3)).alias(f"q{i}") for i in range(3)])


def audited(sig: DataFrame, waves: DataFrame, spectra: DataFrame, survey: DataFrame, rounds: int = 100, folds: int = 3, epochs: int = 20) -> DataFrame:
    """The verdict on every signal from what was measured of it: the ensemble and
    the densities of the survey, the spectrum's descriptors and the network over
    its waves, fused, with false discoveries controlled. sig has signal_id,
    sig_type, true_role, snr and the physics columns; spectra are by obs_id."""
    survey = stored(splits.fit_calibration(survey, "vec_id", "y", 0.75))
    ten = WF.narrowband_score(WF.descriptors(spectra)).withColumnRenamed("obs_id", "signal_id")
    sig = stored(sig.join(ten.select("signal_id", "narrowband", *WF.NARROWBAND), "signal_id", "left"))
    feats = stored(on_survey(sig, survey))
    net = wave_evidence(sig, waves, folds, epochs)
    rows = sig.join(density_evidence(feats, survey), "signal_id").join(descriptor_evidence(sig), "signal_id", "left")
    rows = rows.join(ensemble_evidence(feats, survey, rounds), "signal_id").join(net, "signal_id")
    fused = fusion.bonferroni(F.col("p_h"), F.coalesce("p_d", F.lit(1.0)))
    probs, code = fusion.three_classes(F.col("p_pulsar"), 1 - F.col("p_pulsar"), fused)
    rows = rows.withColumns({"p_fused": fused, "pred": code} | {f"m{i}": c for i, c in enumerate(probs)})
    both = fusion.combine_probs([F.col(f"m{i}") for i in range(3)], [F.col(f"q{i}") for i in range(3)])
    return fusion.arbitrate(rows.withColumns({f"p{i}": c for i, c in enumerate(both)}))


def measured(s, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Signals with the order of their waves, waves, spectra and the survey."""
    waves = stored(A.audit_waves(s, d))
    # disorder of a wave: the entropy of its shares of power, over that of an even one
    total = F.aggregate("wave", F.lit(0.0), lambda a, x: a + F.abs(x))
    entropy = F.aggregate("wave", F.lit(0.0), lambda a, x: a - F.when(x == 0, 0.0).otherwise(F.abs(x) / total * F.log(F.abs(x) / total)))
    chaos = waves.where(F.size("wave") == A.WAVE).groupBy("signal_id").agg((F.avg(entropy) / float(np.log(A.WAVE))).alias("chaos"))
    return stored(A.audit_signals(s, d).join(chaos, "signal_id", "left")), waves, A.audit_spectra(s, d), A.survey(s, d)


@query("production_run")
def production_run(s, d, rounds: int = 100):
    """The verdict on every user's signal, with the evidence that led to it."""
    rows = audited(*measured(s, d), rounds)
    return rows.select("signal_id", "true_role", "narrowband", "p_h", "p_d", "p", "p_fused", "n_waves", *[f"q{i}" for i in range(3)], *[f"p{i}" for i in range(3)], "pred", "ood_mask", "composite", "verdict")


@query("evaluate_ood")
def evaluate_ood(s, d):
    """End-to-end audit: rates of the production run's verdicts by role. The
    gate is the surveyed one; nothing that a verdict rests on is made from the
    role but the null of the descriptors and the labels of the networks that
    did not see the signal."""
    return metrics.role_rates(production_run(s, d)).select("n_anomaly", "n_control", "tpr", "fpr", "passed")


@query("manifold_cross_conformal")
def manifold_cross_conformal(s, d, folds: int = 5):
    """Every normal row is scored by a detector that never saw it; these scores
    are the null for class 9. The gate asks for the false positive rate and the
    coverage; AUROC is for information."""
    v = A.survey(s, d)
    normal = stored(splits.kfold(v.where("class_code <> 9"), "vec_id", "class_code", folds))
    k = normal.agg(F.max("fold")).first()[0]
    if k is None or normal.count() < 6:
        raise ValueError("too few normal rows for a cross-conformal audit")
    each = None
    for i in range(k + 1):
        det = models.Detector.fit(normal.where(F.col("fold") != i), "class_code", A.SURVEY, "mean")
        part = det.score(normal.where(F.col("fold") == i)).select("vec_id", F.round("score", 6).alias("score"))
        each = part if each is None else each.unionByName(part)
    null = stored(each)
    det = models.Detector.fit(normal, "class_code", A.SURVEY, "mean")
    novel = stored(det.score(v.where("class_code = 9")).select("vec_id", F.round("score", 6).alias("score")))
    both = null.withColumn("novel", F.lit(0)).unionByName(novel.withColumn("novel", F.lit(1)))
    tpr = novel.join(conformal.thresholds(null, ALPHA).select("threshold")).agg(F.max("threshold").alias("threshold"), F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("tpr"))
    fpr = conformal.loo_flag_rate(null, ALPHA).select(F.col("rate").alias("fpr"))
    coverage = conformal.leave_one_out(null).agg(F.avg((F.col("p") > ALPHA).cast("double")).alias("coverage"))
    out = conformal.auroc(both, "score", "novel").join(tpr).join(fpr).join(coverage)  # one row each
    return out.withColumn("passed", (F.col("fpr") <= ALPHA + 0.1) & (F.col("coverage") >= 1 - ALPHA))


@query("waveform_classes")
def waveform_classes(s, d, folds: int = 3, epochs: int = 20):
    """(signal_id, window, fold, y, p0, p1, p2, hit): every window with a wave,
    scored by a network that never saw its signal; hit tells whether the likeliest
    class is the role's, and is null for unlabelled signals."""
    rows = wave_scores(A.audit_signals(s, d), A.audit_waves(s, d), folds, epochs)
    best = F.array_position("q", F.array_max("q")) - 1
    return rows.select("signal_id", "window", "fold", "y", *[F.round(F.col("q")[i], 6).alias(f"p{i}") for i in range(3)], (best == F.col("y")).alias("hit"))
