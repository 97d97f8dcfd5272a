"""Queries for lookups of exemplars, carriers, segments and model studies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import physical
from ..operators import boosting, catalogs, conformal, metrics, models, rank, resample, splits
from ..operators import waterfall as WF
from ..session import stored
from ..sources import adapters as A
from ..sources import records
from .registry import query, with_

#: Signal types by the cluster whose exemplars stand for them.
NATURAL, INTERFERENCE = ("view", "signup", "purchase"), ("click",)


def mapped_to_survey(sig, v):
    """(signal_id, sig_type, nearest_id): for each signal (signal_id, sig_type,
    snr) the survey row that stands for it: of its cluster's most typical quarter
    (by Gaussian log density with shrunk covariance) the one whose moment is
    nearest to the signal's mapped ratio; others have none."""
    v = v.withColumn("cluster", F.col("y"))
    pools = None
    for y in (0, 1):
        own = v.where(F.col("cluster") == y)
        n, mean, q, _ = models.moments(own, A.SURVEY)
        cov = q / n - np.outer(mean, mean)
        cov = 0.98 * cov + 0.02 * np.diag(np.diag(cov))
        typical = own.withColumn("d2", F.round(models.quadratic(A.SURVEY, mean, np.linalg.inv(cov)), 9))
        cut = rank.quantiles(typical, ("d2",), (0.25,)).select(F.col("q0").alias("cut"))
        pool = typical.join(F.broadcast(cut)).where("d2 <= cut").select("vec_id", F.round("f5", 6).alias("key"), F.lit(y).alias("cluster"))
        pools = pool if pools is None else pools.unionByName(pool)
    ends = rank.quantiles(v, ("f5",), (0.05, 0.95), ("cluster",)).select("cluster", F.col("q0").alias("lo"), F.col("q1").alias("hi"))
    kind = F.when(F.col("sig_type").isin(*NATURAL), 1).when(F.col("sig_type").isin(*INTERFERENCE), 0)
    sig = sig.select("signal_id", "sig_type", "snr", kind.alias("cluster"))
    mapped = sig.join(ends, "cluster").select("signal_id", "cluster", F.round(physical.snr_to_moment(F.col("snr"), F.col("lo"), F.col("hi")), 6).alias("key"))
    out = None
    for y in (0, 1):
        near = catalogs.nearest(mapped.where(F.col("cluster") == y).select("signal_id", "key"), pools.where(F.col("cluster") == y), "key", "signal_id", "vec_id")
        out = near if out is None else out.unionByName(near)
    return sig.select("signal_id", "sig_type").join(out.select("signal_id", "nearest_id"), "signal_id", "left")


@query("physics_map")
def physics_map(s, d):
    """The survey row that stands for each signal."""
    return mapped_to_survey(A.signals(s, d), A.survey(s, d))


@query("carrier_score")
def carrier_score(s, d):
    """(obs_id, carrier): kurtosis and spectral kurtosis of the brightest channel
    and its steadiness; one Arrow group per channel series."""
    w = A.waterfall(s, d)
    means = w.groupBy("obs_id", "ch").agg(F.round(F.avg("power"), 6).alias("m"))
    best = means.groupBy("obs_id").agg((-F.max(F.struct("m", (-F.col("ch")).alias("i")))["i"]).alias("ch"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"obs_id": [g["obs_id"].iloc[0]], "carrier": [WF.carrier(g.sort_values("t")["power"].to_numpy(float))]})

    return w.join(best, ["obs_id", "ch"]).groupBy("obs_id").applyInPandas(run, "obs_id string, carrier double")


@query(
    "segment_null",
    with_(A.WATERFALL) + """SELECT obs_id, CAST(floor(t * 6 / 31) AS INTEGER) AS segment, count(*) AS n, round(max(power), 6) AS peak FROM waterfall GROUP BY ALL HAVING count(DISTINCT t) >= 4""",
)
def segment_null(s, d):
    """Reference observations cut into time segments, as null samples."""
    w = A.waterfall(s, d).withColumn("segment", F.floor(F.col("t") * 6 / A.N_TIME).cast("int"))
    rows = w.groupBy("obs_id", "segment").agg(F.count("*").alias("n"), F.round(F.max("power"), 6).alias("peak"), F.countDistinct("t").alias("_t"))
    return rows.where("_t >= 4").drop("_t")


@query("segment_descriptors")
def segment_descriptors(s, d):
    """The descriptors of the brightest window of every segment."""
    w = A.waterfall(s, d).withColumn("obs_id", F.concat_ws("#", "obs_id", F.floor(F.col("t") * 6 / A.N_TIME).cast("int")))
    return WF.narrowband_score(WF.descriptors(WF.narrowband_window(w)))


@query("descriptor_pvalues")
def descriptor_pvalues(s, d):
    """High-tail p of whole observations against their segments as the null."""
    null = segment_descriptors(s, d).select(F.col("obs_id").alias("id"), F.round("narrowband", 6).alias("score"), F.lit(1).alias("is_cal"))
    obs = WF.narrowband_score(WF.descriptors(A.waterfall(s, d))).select(F.col("obs_id").alias("id"), F.round("narrowband", 6).alias("score"), F.lit(0).alias("is_cal"))
    return conformal.high_tail(null.unionByName(obs)).where("is_cal = 0").select("id", "score", "p")


@query(
    "descriptor_vector",
    with_(A.SIGNALS) + "SELECT signal_id, coalesce(concentration, 0.0) AS v0, coalesce(spectral_flatness, 0.0) AS v1, coalesce(width_ms, 0.0) AS v2 FROM signals",
)
def descriptor_vector(s, d):
    """Descriptors in fixed order; a missing one is 0."""
    v = F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("concentration", "spectral_flatness", "width_ms")])
    return A.signals(s, d).select("signal_id", v.alias("v")).select("signal_id", *[F.col("v")[i].alias(f"v{i}") for i in range(3)])


@query(
    "narrowband_lookup",
    with_(A.SIGNALS) + "SELECT signal_id, round(CASE WHEN concentration IS NULL AND spectral_flatness IS NULL THEN 0.5 ELSE greatest(0.25, 0.25 * coalesce(concentration, 0.0) + 0.2 * (1 - coalesce(spectral_flatness, 1.0))) END, 6) AS narrowband FROM signals",
)
def narrowband_lookup(s, d):
    sig = A.signals(s, d)
    scored = sig.select("signal_id", F.round(WF.narrowband(sig.columns), 6).alias("narrowband"))
    side = scored.where("narrowband IS NOT NULL")
    return catalogs.fallback(sig.select("signal_id"), side, "signal_id", "narrowband", F.lit(0.5))


_SHARE = "8 + 32 * (CAST('0x' || substr(key, 25, 8) AS BIGINT) / 4294967296.0)"
_FRB = f"""frb AS (SELECT 'FRB_' || CAST(object_id AS VARCHAR) AS name, 'FRB' AS origin, 'FRB' AS sig_type, dm, round({_SHARE}, 6) AS snr, 'Natural' AS true_role
  FROM (SELECT object_id, dm, md5(CAST(object_id AS VARCHAR) || '-42') AS key FROM catalog WHERE dm IS NOT NULL) ORDER BY key, CAST(object_id AS VARCHAR) LIMIT 50)"""
_RFI = f"""rfi AS (SELECT 'RFI_' || CAST(vec_id AS VARCHAR) AS name, 'RFI' AS origin, 'RFI' AS sig_type, 0.0 AS dm, round({_SHARE}, 6) AS snr, 'Interference' AS true_role
  FROM (SELECT vec_id, md5(CAST(vec_id AS VARCHAR) || '-42') AS key FROM survey WHERE y = 0) ORDER BY key, vec_id LIMIT 50)"""


@query("frb_records", with_(A.CATALOG, _FRB) + "SELECT name, origin, sig_type, round(dm, 6) AS dm, snr, true_role FROM frb")
def frb_records(s, d, n: int = 50):
    """A sample of n burst records (a sampling operator), in digest order."""
    rows = records.sampled_bursts(A.catalog(s, d), "object_id", n)
    return rows.withColumn("dm", F.round("dm", 6)).withColumn("snr", F.round("snr", 6))


@query("audit_records", with_(A.CATALOG, A.SURVEY_SQL, _FRB, _RFI) + "SELECT name, origin, sig_type, round(dm, 6) AS dm, snr, true_role FROM (SELECT * FROM frb UNION ALL SELECT * FROM rfi)")
def audit_records(s, d, n: int = 50):
    """The union of audit records; the given tables come without archives."""
    rows = records.audit_set(A.catalog(s, d), A.survey(s, d), A.SURVEY, n, n).records
    return rows.withColumn("dm", F.round("dm", 6)).withColumn("snr", F.round("snr", 6))


@query("unclassified_audit")
def unclassified_audit(s, d, lo: float = 0.4, hi: float = 0.6, rounds: int = 100):
    """All rows that the ensemble cannot classify (probability in [lo, hi]): the
    least and largest p over the class densities, each against all calibration
    rows. A low p_max marks a row that escapes both classes."""
    v = splits.fit_calibration(A.survey(s, d), "vec_id", "y").withColumn("is_cal", 1 - F.col("is_fit"))
    prob = models.probabilities(v, models.ensemble("y", rounds), A.SURVEY)
    mix = models.fit_mixtures(v.where("is_fit = 1"), "y", A.SURVEY, 5)
    each = tuple(f"log_prob_{y}" for y in mix)
    rows = models.log_prob(prob, mix).select("vec_id", "y", "prob", "is_cal", *[F.round(c, 6).alias(c) for c in each])
    return conformal.over_scores(rows, each).where(F.col("prob").between(lo, hi)).select(F.col("vec_id").alias("id"), "y", "prob", "p_min", "p_max")


@query("unclassified_top")
def unclassified_top(s, d, k: int = 20):
    """The k unclassified rows that are rarest under both classes."""
    return unclassified_audit(s, d).orderBy("p_max", "id").limit(k)


@query("auroc_bootstrap")
def auroc_bootstrap(s, d, replicates: int = 1000):
    """(n, auroc, low, high): Poisson bootstrap of the AUROC over both pools."""
    return resample.auroc(A.predictions(s, d), "prob", "y", "id", replicates)


SIZES, CURVE_FOLDS = (0.1, 0.2, 0.4, 0.6, 0.8, 1.0), 5


@query("learning_curve")
def learning_curve(s, d):
    """(share, fold, n, accuracy, mcc): a forest on six growing shares of what is
    outside a fold, scored on the fold. The shares are nested."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    v = splits.kfold(A.survey(s, d), "vec_id", "y", CURVE_FOLDS).withColumn("u", splits.hashed_fraction("vec_id", 7))
    rows, out = stored(VectorAssembler(inputCols=list(A.SURVEY), outputCol="features").transform(v)), None
    for share in SIZES:
        for k in range(CURVE_FOLDS):
            part = rows.where((F.col("fold") != k) & (F.col("u") < share))
            model = RandomForestClassifier(labelCol="y", numTrees=10, maxDepth=5, seed=42).fit(part)
            m = metrics.binary(model.transform(rows.where(F.col("fold") == k)).withColumn("p", F.col("prediction").cast("int")), "y", "p")
            r = m.select(F.lit(share).alias("share"), F.lit(k).alias("fold"), F.lit(part.count()).alias("n"), "accuracy", "mcc")
            out = r if out is None else out.unionByName(r)
    return out


#: The grid: learning rates, depths (a tree of depth d has 2^d leaves) and L2.
GRID = [(rate, depth, l2) for rate in (0.05, 0.1, 0.2) for depth in (2, 3, 4) for l2 in (0.0, 1.0)]
OUTER, INNER = 5, 3


def nested_search(v, rounds: int, bins: int = 16):
    """(fold, rate, depth, l2, inner_mcc, tp .. mcc): in every outer fold the cell
    of the grid with the best mean MCC over inner folds of the rest, and what it
    scores on the fold. All cells of all folds are one fit over shared bins."""
    rows = splits.kfold(splits.kfold(v, "vec_id", "y", OUTER).withColumnRenamed("fold", "outer"), "vec_id", "y", INNER, 43)
    rows = stored(rows.withColumn("part", F.col("outer") * INNER + F.col("fold")))
    part = np.arange(OUTER * INNER)
    each = [(g, o, i) for g in range(len(GRID)) for o in range(OUTER) for i in range(INNER)]
    use = np.array([(part // INNER != o) & (part % INNER != i) for _, o, i in each])
    rate, depth, l2 = (np.array([GRID[g][k] for g, *_ in each]) for k in range(3))
    search = boosting.Boosted.fit(rows, "y", "part", A.SURVEY, boosting.Plan(use, 2, rate, l2, 20, depth), rounds, bins=bins)
    seen = search.every_prediction().withColumns({"cell": F.floor(F.col("model") / (OUTER * INNER)), "o": F.floor(F.col("model") / INNER) % OUTER, "i": F.col("model") % INNER})
    held = seen.where((F.floor(F.col("_part") / INNER) != F.col("o")) & (F.col("_part") % INNER == F.col("i")))
    hit = lambda t, q: F.sum(F.when((F.col("_y") == t) & (F.col("prediction") == q), F.col("n")).otherwise(0)).cast("double")
    c = held.groupBy("cell", "o", "i").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    mcc = metrics.ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    mean = c.select("cell", "o", mcc.alias("m")).groupBy("cell", "o").agg(F.round(F.avg("m"), 9).alias("m"))
    best = mean.groupBy("o").agg(F.max(F.struct("m", (-F.col("cell")).alias("c"))).alias("b")).select("o", F.col("b.m").alias("m"), (-F.col("b.c")).alias("cell")).collect()
    found = {int(r["o"]): (float(r["m"]), *GRID[int(r["cell"])]) for r in best}  # a row for each outer fold
    own = [found[o] for o in range(OUTER)]
    plan = boosting.Plan(~np.eye(OUTER, dtype=bool), 2, np.array([x[1] for x in own]), np.array([x[3] for x in own]), 20, np.array([x[2] for x in own]))
    last = boosting.Boosted.fit(rows, "y", "outer", A.SURVEY, plan, rounds, bins=bins).probabilities(list(range(OUTER)))
    scored = metrics.binary(last.select(F.col("_part").alias("fold"), F.col("_y").alias("y"), "prediction"), "y", "prediction", by=("fold",))
    cells = v.sparkSession.createDataFrame([(o, x[1], x[2], x[3], x[0]) for o, x in found.items()], "fold int, rate double, depth int, l2 double, inner_mcc double")
    return cells.join(scored, "fold")


@query("grid_search")
def grid_search(s, d, rounds: int = 20):
    """Nested search over 18 cells, three inner and five outer folds."""
    return nested_search(A.survey(s, d), rounds)
