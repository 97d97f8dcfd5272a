"""Queries over scores, predictions and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalogs as C
from ..operators import conformal, fusion, metrics
from ..sources import adapters as A
from .registry import query, with_

_LOW = "sum(is_cal) OVER ({p} ORDER BY score RANGE UNBOUNDED PRECEDING)"


def _p(x="p"):
    return F.round(x, 6).alias("p")


@query("conformal_low_tail", with_(A.SCORES) + "SELECT id, is_cal, round((sum(is_cal) OVER (ORDER BY score RANGE UNBOUNDED PRECEDING) + 1) / (sum(is_cal) OVER () + 1), 6) AS p FROM scores")
def conformal_low_tail(s, d):
    return conformal.low_tail(A.scores(s, d)).select("id", "is_cal", _p())


@query("conformal_high_tail", with_(A.SCORES) + "SELECT id, is_cal, round((sum(is_cal) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) + 1) / (sum(is_cal) OVER () + 1), 6) AS p FROM scores")
def conformal_high_tail(s, d):
    return conformal.high_tail(A.scores(s, d)).select("id", "is_cal", _p())


_CLASS_P = """
classp AS (SELECT id, class_name, score, is_cal,
  (sum(is_cal) OVER (PARTITION BY class_name ORDER BY score RANGE UNBOUNDED PRECEDING) + 1) / (sum(is_cal) OVER (PARTITION BY class_name) + 1) AS p FROM scores)"""


@query("conformal_class_conditional", with_(A.SCORES, _CLASS_P) + "SELECT id, class_name, round(p, 6) AS p FROM classp WHERE is_cal = 0")
def conformal_class_conditional(s, d):
    return conformal.low_tail(A.scores(s, d), by=("class_name",)).where("is_cal = 0").select("id", "class_name", _p())


@query(
    "conformal_min_max_class",
    with_(A.SCORES)
    + """, classes AS (SELECT DISTINCT class_name AS c FROM scores WHERE is_cal = 1),
cal AS (SELECT class_name AS c, score FROM scores WHERE is_cal = 1),
allrows AS (SELECT id, c, score, 0 AS k FROM scores, classes WHERE is_cal = 0 UNION ALL SELECT NULL, c, score, 1 FROM cal),
ps AS (SELECT id, c, k, (sum(k) OVER (PARTITION BY c ORDER BY score RANGE UNBOUNDED PRECEDING) + 1) / (sum(k) OVER (PARTITION BY c) + 1) AS p FROM allrows)
SELECT id, round(min(p), 6) AS p_min, round(max(p), 6) AS p_max, first(c ORDER BY p, c) AS assigned FROM ps WHERE k = 0 GROUP BY id""",
)
def conformal_min_max_class(s, d):
    return conformal.over_classes(A.scores(s, d)).select("id", F.round("p_min", 6).alias("p_min"), F.round("p_max", 6).alias("p_max"), "assigned")


@query("conformal_loo_pvalue", with_(A.SCORES) + "SELECT id, round(count(*) OVER (ORDER BY score DESC RANGE UNBOUNDED PRECEDING) / count(*) OVER (), 6) AS p FROM scores")
def conformal_loo_pvalue(s, d):
    return conformal.leave_one_out(A.scores(s, d)).select("id", _p())


_K = "least(greatest(CAST(ceil(0.9::DOUBLE * (n + 1)) AS BIGINT) - 1, 0), n - 1)"


@query(
    "conformal_threshold",
    with_(A.SCORES) + f"""SELECT class_name, n, score AS threshold FROM (
  SELECT class_name, score, row_number() OVER (PARTITION BY class_name ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY class_name) AS n FROM scores) WHERE i = {_K}""",
)
def conformal_threshold(s, d):
    return conformal.thresholds(A.scores(s, d), 0.1, by=("class_name",))


@query(
    "conformal_loo_fpr",
    with_(A.SCORES) + f"""
, r AS (SELECT class_name, score, row_number() OVER (PARTITION BY class_name ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY class_name) AS n FROM scores),
k AS (SELECT *, {_K.replace("(n + 1)", "n").replace("n - 1)", "n - 2)")} AS k FROM r),
t AS (SELECT class_name, max(CASE WHEN i = k THEN score END) AS a, max(CASE WHEN i = k + 1 THEN score END) AS b FROM k GROUP BY class_name)
SELECT class_name, n, CAST(sum(CASE WHEN score > CASE WHEN i > k THEN a ELSE b END THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
  round(sum(CASE WHEN score > CASE WHEN i > k THEN a ELSE b END THEN 1 ELSE 0 END) / n, 6) AS rate FROM k JOIN t USING (class_name) GROUP BY class_name, n""",
)
def conformal_loo_fpr(s, d):
    return conformal.loo_flag_rate(A.scores(s, d), 0.1, by=("class_name",)).select("class_name", "n", "flagged", F.round("rate", 6).alias("rate"))


_BH = """
t AS (SELECT id, class_name, p FROM classp WHERE is_cal = 0), r AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM t),
cut AS (SELECT max(p) AS c FROM r WHERE p * m <= 0.2 * i)"""


@query("bh_fdr", with_(A.SCORES, _CLASS_P, _BH) + "SELECT id, round(p, 6) AS p, coalesce(p <= c, false) AS rejected FROM t, cut")
def bh_fdr(s, d):
    p = conformal.low_tail(A.scores(s, d), by=("class_name",)).where("is_cal = 0")
    return conformal.bh(p, 0.2).select("id", _p(), "rejected")


@query(
    "auroc_mann_whitney",
    with_(A.PREDICTIONS) + """SELECT CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg,
  round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auroc
FROM (SELECT y, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2 AS rk FROM predictions)""",
)
def auroc_mann_whitney(s, d):
    return conformal.auroc(A.predictions(s, d), "prob").select("n_pos", "n_neg", F.round("auroc", 6).alias("auroc"))


_ROC = """
c AS (SELECT prob AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM predictions GROUP BY prob),
roc AS (SELECT threshold, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, pos, sum(pos) OVER () AS np, sum(neg) OVER () AS nn
  FROM c WINDOW w AS (ORDER BY threshold DESC))"""


@query("roc_curve", with_(A.PREDICTIONS, _ROC) + "SELECT threshold, tp, fp, round(tp / nullif(np, 0), 6) AS tpr, round(fp / nullif(nn, 0), 6) AS fpr FROM roc")
def roc_curve(s, d):
    return conformal.roc(A.predictions(s, d), "prob").select("threshold", "tp", "fp", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query("pr_curve_ap", with_(A.PREDICTIONS, _ROC) + "SELECT CAST(max(np) AS BIGINT) AS n_pos, round(sum(tp / (tp + fp) * pos / np), 6) AS average_precision FROM roc")
def pr_curve_ap(s, d):
    return conformal.average_precision(A.predictions(s, d), "prob").select("n_pos", F.round("average_precision", 6).alias("average_precision"))


# metrics

_BIN = """
c AS (SELECT CAST(count(*) FILTER (y = 1 AND pred_a = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND pred_a = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (y = 1 AND pred_a = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (y = 0 AND pred_a = 0) AS DOUBLE) AS tn FROM predictions)"""


@query("binary_metrics", with_(A.PREDICTIONS, _BIN) + """SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def binary_metrics(s, d):
    return metrics.binary(A.predictions(s, d)).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("mcc_binary", with_(A.PREDICTIONS, _BIN) + "SELECT round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM c")
def mcc_binary(s, d):
    return metrics.binary(A.predictions(s, d)).select(F.round("mcc", 6).alias("mcc"))


@query("confusion_matrix", with_(A.MULTICLASS) + "SELECT t, p, count(*) AS n FROM multiclass GROUP BY t, p")
def confusion_matrix(s, d):
    return metrics.confusion(A.multiclass(s, d)).select("t", "p", "n")


@query("confusion_normalized", with_(A.MULTICLASS) + "SELECT t, p, round(count(*) / sum(count(*)) OVER (PARTITION BY t), 6) AS share FROM multiclass GROUP BY t, p")
def confusion_normalized(s, d):
    return metrics.confusion(A.multiclass(s, d)).select("t", "p", F.round("share", 6).alias("share"))


_PER = """
tt AS (SELECT t AS k, count(*) AS support FROM multiclass GROUP BY t), pp AS (SELECT p AS k, count(*) AS predicted, count(*) FILTER (t = p) AS hits FROM multiclass GROUP BY p),
per AS (SELECT coalesce(tt.k, pp.k) AS class_code, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits FROM tt FULL JOIN pp ON tt.k = pp.k),
f AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2 * hits / nullif(support + predicted, 0), 0) AS f1 FROM per)"""


@query("f1_per_class", with_(A.MULTICLASS, _PER) + "SELECT class_code, support, predicted, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def f1_per_class(s, d):
    r = metrics.per_class(A.multiclass(s, d))
    return r.select("class_code", "support", "predicted", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("balanced_accuracy", with_(A.MULTICLASS, _PER) + """SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy,
  round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f""")
def balanced_accuracy(s, d):
    return metrics.multiclass(A.multiclass(s, d)).select(*[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1")])


@query("mcc_multiclass", with_(A.MULTICLASS, _PER) + """SELECT round((sum(hits) * sum(support) - sum(support * predicted))
  / sqrt((sum(support) ** 2 - sum(predicted ** 2)) * (sum(support) ** 2 - sum(support ** 2))), 6) AS mcc FROM f""")
def mcc_multiclass(s, d):
    return metrics.multiclass(A.multiclass(s, d)).select(F.round("mcc", 6).alias("mcc"))


@query("mcnemar", with_(A.PREDICTIONS) + """SELECT b01, b10, round(CASE WHEN b01 + b10 = 0 THEN 0 ELSE (abs(b01 - b10) - 1) ** 2 / (b01 + b10) END, 6) AS statistic FROM (
  SELECT count(*) FILTER (pred_a <> y AND pred_b = y) AS b01, count(*) FILTER (pred_a = y AND pred_b <> y) AS b10 FROM predictions)""")
def mcnemar(s, d):
    return metrics.mcnemar(A.predictions(s, d)).select("b01", "b10", F.round("statistic", 6).alias("statistic"))


@query("wilson_ci", with_(A.PREDICTIONS) + """SELECT n, k, round((p + 3.8416 / (2 * n) - h) / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n) + h) / (1 + 3.8416 / n), 6) AS high FROM (
  SELECT n, k, p, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) AS h FROM (SELECT count(*) AS n, count(*) FILTER (pred_a = y) AS k, count(*) FILTER (pred_a = y) / count(*) AS p FROM predictions))""")
def wilson_ci(s, d):
    return metrics.wilson(A.predictions(s, d), F.col("pred_a") == F.col("y")).select("n", "k", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


_EDGES = "[" + ", ".join(f"quantile_cont(prob, {i / 10})" for i in range(1, 10)) + "]"


@query("calibration_curve", with_(A.PREDICTIONS) + f"""SELECT bin, count(*) AS n, round(avg(prob), 6) AS mean_prob, round(avg(y), 6) AS rate FROM (
  SELECT prob, y, CAST(len(list_filter(e, lambda x: x < prob)) AS INTEGER) AS bin FROM predictions, (SELECT {_EDGES} AS e FROM predictions)) GROUP BY bin""")
def calibration_curve(s, d):
    return metrics.calibration_curve(A.predictions(s, d)).select("bin", "n", F.round("mean_prob", 6).alias("mean_prob"), F.round("rate", 6).alias("rate"))


@query("score_histogram", with_(A.SCORES) + """SELECT CAST(least(floor((score - lo) / (hi - lo) * 39), 38) AS INTEGER) AS bin, count(*) AS n FROM scores,
  (SELECT quantile_cont(score, 0.005) AS lo, quantile_cont(score, 0.995) AS hi FROM scores) WHERE score BETWEEN lo AND hi GROUP BY 1""")
def score_histogram(s, d):
    return metrics.histogram(A.scores(s, d), "score")


_PRED = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"
_T = "greatest(0.0, least(1.0, 0.6 * coalesce(concentration, 0.0) + 0.4 * (1 - coalesce(spectral_flatness, 1.0))))"
#: The two given descriptors; without the others a carrier's part is 0.25.
_NARROW = "CASE WHEN concentration IS NULL AND spectral_flatness IS NULL THEN 0.5 ELSE greatest(0.25, 0.25 * coalesce(concentration, 0.0) + 0.2 * (1 - coalesce(spectral_flatness, 1.0))) END"
_EVIDENCE = f"""
e1 AS (SELECT *, least(p_h, coalesce(p_d, 1.0)) AS p, {_PRED} AS pred, {_T} AS t0 FROM signals),
e2 AS (SELECT *, CASE WHEN pred IN (0, 2) AND p0 + p2 >= 0.8 THEN least(1.0, t0 * 1.25) ELSE t0 END AS t,
  CASE WHEN is_extragalactic AND dm IS NOT NULL AND dm_gal_max IS NOT NULL THEN CASE WHEN dm - dm_gal_max <= 0 THEN 0.0
    ELSE greatest(0.0, least(1.0, 1 - exp(-(dm - dm_gal_max) / greatest(abs(dm_gal_max), 1e-12)))) END ELSE 0.5 END AS disp,
  CASE WHEN width_ms > 0 AND period_s > 0 THEN greatest(0.0, least(1.0, (width_ms / 1000 / period_s - 0.001) / 0.014)) ELSE 0.5 END AS duty FROM e1),
e3 AS (SELECT *, CASE WHEN dm IS NOT NULL OR (width_ms IS NOT NULL AND period_s IS NOT NULL)
    THEN greatest(0.0, least(1.0, 0.7 * t + 0.3 * (1 - (disp + duty) / 2))) ELSE t END AS physics,
  greatest(0.0, least(1.0, coalesce(1 - chaos, 0.5))) AS ord, {_NARROW} AS narrow FROM e2),
ev AS (SELECT *, round(greatest(0.0, least(100.0, least(50.0, -10 * log10(greatest(p, 1e-5))) + 50 * (p2 + ord + narrow + physics) / 4)), 6) AS composite FROM e3),
bhr AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS m FROM ev), bhc AS (SELECT max(p) AS c FROM bhr WHERE p * m <= 0.1 * i),
verdicts AS (SELECT signal_id, sig_type, true_role, p, composite, coalesce(p <= c, false) AS rejected,
  CASE WHEN ood_mask OR p < 0.05 THEN 'Anomaly'
       WHEN greatest(p0, p1) >= 0.8 AND physics < 0.6 THEN CASE WHEN pred = 0 THEN 'Natural' ELSE 'Interference' END
       WHEN greatest(p0, p1) >= 0.8 THEN 'Candidate — Requires Review'
       WHEN coalesce(p <= c, false) OR pred = 2 OR composite >= 50 THEN 'Candidate — Requires Review'
       WHEN pred = 1 THEN 'Interference' ELSE 'Natural' END AS verdict FROM ev, bhc)"""


@query("composite_score", with_(A.SIGNALS, _EVIDENCE) + "SELECT signal_id, composite FROM ev")
def composite_score(s, d):
    return fusion.with_evidence(A.signals(s, d)).select("signal_id", "composite")


@query("arbitrate_verdicts", with_(A.SIGNALS, _EVIDENCE) + "SELECT signal_id, p, composite, rejected, verdict FROM verdicts")
def arbitrate_verdicts(s, d):
    return fusion.arbitrate(A.signals(s, d)).select("signal_id", "p", "composite", "rejected", "verdict")


@query("role_rates", with_(A.SIGNALS, _EVIDENCE) + """, r AS (SELECT count(*) FILTER (true_role = 'Anomaly') AS n_anomaly, count(*) FILTER (true_role IN ('Natural', 'Interference')) AS n_control,
  count(*) FILTER (true_role = 'Anomaly' AND verdict = 'Anomaly') AS t, count(*) FILTER (true_role IN ('Natural', 'Interference') AND verdict = 'Anomaly') AS f FROM verdicts)
SELECT n_anomaly, n_control, round(coalesce(t / nullif(n_anomaly, 0), 1), 6) AS tpr, round(coalesce(f / nullif(n_control, 0), 0), 6) AS fpr,
  coalesce(t / nullif(n_anomaly, 0), 1) >= 0.9 AND coalesce(f / nullif(n_control, 0), 0) <= 0.1 AS passed FROM r""")
def role_rates(s, d):
    return metrics.role_rates(fusion.arbitrate(A.signals(s, d))).select("n_anomaly", "n_control", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"), "passed")


@query("role_counts", with_(A.SIGNALS) + "SELECT true_role, count(*) AS n FROM signals GROUP BY true_role")
def role_counts(s, d):
    return A.signals(s, d).groupBy("true_role").agg(F.count("*").alias("n"))


@query("by_type_summary", with_(A.SIGNALS) + """SELECT sig_type AS kind, count(*) AS n, count(*) FILTER (p_h < 0.05) AS ood_count, round(avg(p_h), 6) AS mean_score, round(min(p_h), 6) AS min_score,
  round(count(*) FILTER (p_h < 0.05) / count(*), 6) AS ood_fraction FROM signals GROUP BY sig_type""")
def by_type_summary(s, d):
    r = metrics.by_type(A.signals(s, d), "sig_type", "p_h", F.col("p_h") < 0.05)
    return r.select("kind", "n", "ood_count", *[F.round(c, 6).alias(c) for c in ("mean_score", "min_score", "ood_fraction")])


_PD = "coalesce(p_d, 1.0)"


@query("fuse_bonferroni", with_(A.SIGNALS) + f"SELECT signal_id, round(least(1.0, 2 * p_h, 2 * {_PD}), 6) AS p FROM signals")
def fuse_bonferroni(s, d):
    return A.signals(s, d).select("signal_id", _p(fusion.bonferroni(F.col("p_h"), F.coalesce("p_d", F.lit(1.0)))))


@query("fuse_fisher", with_(A.SIGNALS) + f"""SELECT signal_id, round(CASE WHEN p_h <= 0 OR {_PD} <= 0 THEN 0.0 ELSE exp(ln(CASE WHEN p_h > 0 THEN p_h END) + ln(CASE WHEN {_PD} > 0 THEN {_PD} END))
  * (1 - ln(CASE WHEN p_h > 0 THEN p_h END) - ln(CASE WHEN {_PD} > 0 THEN {_PD} END)) END, 6) AS p FROM signals""")
def fuse_fisher(s, d):
    return A.signals(s, d).select("signal_id", _p(fusion.fisher(F.col("p_h"), F.coalesce("p_d", F.lit(1.0)))))


@query("fuse_min", with_(A.SIGNALS) + f"SELECT signal_id, least(p_h, {_PD}) AS p FROM signals")
def fuse_min(s, d):
    return A.signals(s, d).select("signal_id", fusion.smallest(F.col("p_h"), F.coalesce("p_d", F.lit(1.0))).alias("p"))


@query("three_class_map", with_(A.SIGNALS) + "SELECT signal_id, round(1 - p_h, 6) AS p_anomaly, CASE WHEN p0 >= p1 AND p0 >= 1 - p_h THEN 0 WHEN p1 >= 1 - p_h THEN 1 ELSE 2 END AS code FROM signals")
def three_class_map(s, d):
    probs, code = fusion.three_classes(F.col("p0"), F.col("p1"), F.col("p_h"))
    return A.signals(s, d).select("signal_id", F.round(probs[2], 6).alias("p_anomaly"), code.alias("code"))


_G = [f"sqrt(greatest(p{i} * c{i}, 1e-12))" for i in range(3)]


@query(
    "combine_probs",
    with_(A.SIGNALS)
    + ", s AS (SELECT *, chaos AS c0, CASE WHEN chaos IS NOT NULL THEN (1 - chaos) / 2 END AS c1, CASE WHEN chaos IS NOT NULL THEN (1 - chaos) / 2 END AS c2 FROM signals) SELECT signal_id, "
    + ", ".join(f"round(CASE WHEN chaos IS NULL THEN p{i} ELSE {_G[i]} / ({' + '.join(_G)}) END, 6) AS q{i}" for i in range(3))
    + " FROM s",
)
def combine_probs(s, d):
    c = F.col("chaos")
    q = fusion.combine_probs([F.col(f"p{i}") for i in range(3)], [c, (1 - c) / 2, (1 - c) / 2])
    return A.signals(s, d).select("signal_id", *[F.round(x, 6).alias(f"q{i}") for i, x in enumerate(q)])


# joins and top lists


@query("left_join_fallback", with_(A.SIGNALS) + """, side AS (SELECT o_orderkey AS signal_id, round(o_totalprice, 2) AS measured FROM orders WHERE o_orderkey % 2 = 0)
SELECT s.signal_id, coalesce(measured, 0.5) AS measured FROM signals s LEFT JOIN side ON s.signal_id = side.signal_id""")
def left_join_fallback(s, d):
    side = A.table(s, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("signal_id"), F.round("o_totalprice", 2).alias("measured"))
    return C.fallback(A.signals(s, d), side, "signal_id", "measured", F.lit(0.5)).select("signal_id", "measured")


@query("semi_join_null", with_(A.SIGNALS) + "SELECT signal_id, p_h FROM signals s WHERE true_role IN ('Natural', 'Interference') AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = s.signal_id AND o_orderstatus = 'O')")
def semi_join_null(s, d):
    side = A.table(s, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("signal_id"))
    return A.signals(s, d).where(F.col("true_role").isin("Natural", "Interference")).join(side, "signal_id", "left_semi").select("signal_id", "p_h")


@query("anti_join_calibration", with_(A.SCORES) + "SELECT id, score FROM scores WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = id)")
def anti_join_calibration(s, d):
    fit = A.table(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    return A.scores(s, d).join(fit, "id", "left_anti").select("id", "score")


@query("uncertainty_pool", with_(A.PREDICTIONS) + "SELECT id, prob FROM predictions WHERE prob BETWEEN 0.4 AND 0.6")
def uncertainty_pool(s, d):
    return A.predictions(s, d).where(F.col("prob").between(0.4, 0.6)).select("id", "prob")


@query("topk_by_p", with_(A.SIGNALS) + "SELECT signal_id, sig_type, p_h FROM signals ORDER BY p_h, signal_id LIMIT 25")
def topk_by_p(s, d):
    return C.top_k(A.signals(s, d).select("signal_id", "sig_type", "p_h"), "p_h", 25, "signal_id")


@query("best_model", with_(A.PREDICTIONS) + """, m AS (SELECT 'a' AS model, avg(CASE WHEN pred_a = y THEN 1.0 ELSE 0.0 END) AS accuracy FROM predictions
  UNION ALL SELECT 'b', avg(CASE WHEN pred_b = y THEN 1.0 ELSE 0.0 END) FROM predictions) SELECT first(model ORDER BY accuracy DESC, model) AS model, round(max(accuracy), 6) AS accuracy FROM m""")
def best_model(s, d):
    p = A.predictions(s, d)
    a = metrics.binary(p, p="pred_a").select(F.lit("a").alias("model"), "accuracy")
    b = metrics.binary(p, p="pred_b").select(F.lit("b").alias("model"), "accuracy")
    return a.unionByName(b).orderBy(F.col("accuracy").desc(), "model").limit(1).select("model", F.round("accuracy", 6).alias("accuracy"))
