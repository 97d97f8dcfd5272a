"""Queries that fit models (rows only: fits have no SQL twin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, catalogs, conformal, extratrees, leafwise, metrics, models, resample, splits
from ..session import stored
from ..sources import adapters as A
from .registry import query


@query("mahalanobis_scores")
def mahalanobis_scores(s, d):
    v = A.survey(s, d)
    det = models.Detector.fit(v.where("class_code <> 9"), "class_code", A.SURVEY)
    return det.score(v).select("vec_id", "class_code", F.round("score", 6).alias("score"))


@query("manifold_conformal")
def manifold_conformal(s, d):
    """Mean-centred detector on the normal classes; p by the calibration part."""
    v = splits.fit_calibration(A.survey(s, d), "vec_id", "class_code")
    normal = F.col("class_code") != 9
    det = models.Detector.fit(v.where(normal & (F.col("is_fit") == 1)), "class_code", A.SURVEY, "mean")
    rows = det.score(v).withColumn("is_cal", (normal & (F.col("is_fit") == 0)).cast("int"))
    return conformal.high_tail(rows).select("vec_id", "class_code", "is_cal", F.round("score", 6).alias("score"), F.round("p", 6).alias("p"))


@query("gmm_log_density")
def gmm_log_density(s, d):
    v = A.survey(s, d)
    return models.log_prob(v, models.fit_mixtures(v, "y", A.SURVEY)).select("vec_id", "y", "log_prob", "log_prob_0", "log_prob_1")


@query("population_ood")
def population_ood(s, d):
    """Leave-class-out audit: class 9 is novel; AUROC, threshold rate, coverage."""
    v = A.survey(s, d).withColumn("novel", (F.col("class_code") == 9).cast("int"))
    rows = models.Detector.fit(v.where("novel = 0"), "class_code", A.SURVEY).score(v).withColumn("score", F.round("score", 6))
    normal = rows.where("novel = 0")
    cut = conformal.thresholds(normal, 0.1)
    tpr = rows.where("novel = 1").join(cut).agg(F.avg((F.col("score") > F.col("threshold")).cast("double")).alias("tpr"))
    p = conformal.leave_one_out(normal).agg(F.avg((F.col("p") > 0.1).cast("double")).alias("coverage"))
    fpr = conformal.loo_flag_rate(normal, 0.1).select(F.col("rate").alias("fpr"))
    out = conformal.auroc(rows, "score", "novel").join(tpr).join(fpr).join(p)
    return out.withColumn("passed", (F.col("auroc") >= 0.9) & (F.col("tpr") >= 0.9) & (F.col("fpr") <= 0.2))


@query("curated_audit")
def curated_audit(s, d):
    """Fit on 70 % of the survey; rows below the floor by the margin are off."""
    v = splits.fit_calibration(A.survey(s, d), "vec_id", "y")
    fit = v.where("is_fit = 1")
    mix = models.fit_mixtures(fit, "y", A.SURVEY, 2)
    floor = models.log_prob(fit, mix).agg(F.min("log_prob").alias("floor"))
    return models.on_manifold(models.log_prob(v, mix).join(floor), F.col("floor")).select("vec_id", "y", "log_prob", "ood")


@query("real_catalog_audit")
def real_catalog_audit(s, d):
    """All catalog rows: features, medians of the fit part, class densities,
    least and largest class p against the calibration part."""
    f = stored(splits.fit_calibration(catalogs.featurize(A.catalog(s, d)), "object_id", "class_name"))
    from ..functions.physical import CONTINUOUS

    rows = stored(catalogs.impute(f, catalogs.medians(f.where("is_fit = 1"))))
    mix = models.fit_mixtures(rows.where("is_fit = 1"), "class_name", CONTINUOUS, 5)
    scored = models.log_prob(rows, mix).select(F.col("object_id").alias("id"), "class_name", F.round("log_prob", 6).alias("score"), (1 - F.col("is_fit")).alias("is_cal"))
    return conformal.over_classes(scored, every=True)


@query("real_catalog_top")
def real_catalog_top(s, d, k: int = 20):
    """The k catalog rows that are rarest under some class."""
    return real_catalog_audit(s, d).orderBy("p_min", "p_max", "id").limit(k)


@query("ensemble_oof")
def ensemble_oof(s, d):
    from pyspark.ml.classification import GBTClassifier

    gbt = GBTClassifier(labelCol="y", maxIter=5, maxDepth=4, seed=42)
    return metrics.binary(models.out_of_fold(A.survey(s, d), gbt, "y", A.SURVEY, "vec_id"), "y", "prediction", by=("fold",))


@query("population_classification")
def population_classification(s, d):
    from pyspark.ml.classification import RandomForestClassifier

    forest = RandomForestClassifier(labelCol="class_code", numTrees=10, maxDepth=6, seed=42)
    oof = models.out_of_fold(A.survey(s, d), forest, "class_code", A.SURVEY, "vec_id")
    out = metrics.multiclass(oof, "class_code", "prediction")
    return out.withColumn("passed", (F.col("mcc") >= 0.6) & (F.col("weighted_f1") >= 0.9))


@query("population_boosting")
def population_boosting(s, d, rounds: int = 300, folds: int = 5):
    """(model, n, accuracy, balanced_accuracy, macro_f1, weighted_f1, mcc, passed):
    300 rounds of histogram boosting, grown leaf by leaf to 31 leaves, beside a
    forest of 100 trees, both out of fold on the same folds, in which rows of one
    id stay together. Medians of the training folds fill missing values. Rows
    without a class are a class."""
    from pyspark.ml.classification import RandomForestClassifier

    v = splits.group_kfold(A.survey(s, d), "vec_id", "class_code", folds)
    v = stored(splits.ranked(v.withColumn("_part", F.struct("class_code", "fold")), "vec_id", "_part", splits.SEED + 1))
    names = sorted((r[0] for r in v.select("class_code").distinct().collect()), key=lambda c: (c is None, c))
    of = F.coalesce(*[F.when(F.col("class_code").eqNullSafe(F.lit(c)), i) for i, c in enumerate(names)], F.lit(0))
    v = v.select("vec_id", *A.SURVEY, "fold", of.cast("int").alias("y"), (F.col("_i") % 10 == 0).alias("tenth"))
    there = sorted(r[0] for r in v.select("fold").distinct().collect())
    boosted = leafwise.out_of_fold(v, "y", "fold", "tenth", A.SURVEY, len(names), there, rounds, (), ("vec_id",))
    forest = RandomForestClassifier(labelCol="y", numTrees=100, maxDepth=10, seed=42)
    each = {"boosted": boosted, "forest": models.imputed_out_of_fold(v, forest, "y", "fold", A.SURVEY, there)}
    out = None
    for name, oof in each.items():
        m = metrics.multiclass(stored(oof), "y", "prediction")
        r = m.select(F.lit(name).alias("model"), "*", ((F.col("mcc") >= 0.6) & (F.col("weighted_f1") >= 0.9)).alias("passed"))
        out = r if out is None else out.unionByName(r)
    return out


@query("baseline_models")
def baseline_models(s, d, folds: int = 3):
    """Accuracy, F1 and MCC of the baselines, out of fold on the same folds. The
    kernel machine is a linear one on 256 random Fourier features."""
    from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    v = stored(splits.kfold(A.survey(s, d), "vec_id", "y", folds))
    each = {
        "LR": LogisticRegression(labelCol="y", maxIter=20), "RF": RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=5, seed=42),
        "SVM-linear": LinearSVC(labelCol="y", maxIter=20),
    }
    oof = {name: models.out_of_fold(v.drop("fold"), est, "y", A.SURVEY, "vec_id", folds) for name, est in each.items()}
    rows = stored(models.fourier(v, A.SURVEY).select("vec_id", "y", "fold", array_to_vector("kernel").alias("features")))
    parts = [LinearSVC(labelCol="y", maxIter=20, regParam=1e-3).fit(rows.where(F.col("fold") != k)).transform(rows.where(F.col("fold") == k)) for k in range(folds)]
    kernel = parts[0]
    for p in parts[1:]:
        kernel = kernel.unionByName(p)
    oof["SVM-RBF"] = kernel.select("y", F.col("prediction").cast("int").alias("prediction"))
    oof["ExtraTrees"] = extratrees.out_of_fold(v, "y", "fold", A.SURVEY, 2, folds, ("vec_id",)).withColumnRenamed("_y", "y")
    oof["Boosted"] = boosting.out_of_fold(v, "y", "fold", A.SURVEY, 2, folds, 50, ("vec_id",)).withColumnRenamed("_y", "y")
    out = None
    for name, rows in oof.items():
        m = metrics.binary(rows, "y", "prediction").select(F.lit(name).alias("model"), "accuracy", "f1", "mcc")
        out = m if out is None else out.unionByName(m)
    return out


@query("feature_importance")
def feature_importance(s, d):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(A.SURVEY), outputCol="features").transform(A.survey(s, d))
    model = RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=5, seed=42).fit(rows)
    return s.createDataFrame(sorted(zip(A.SURVEY, map(float, model.featureImportances.toArray()), strict=True), key=lambda x: -x[1]), "feature string, importance double")


@query("pca_embedding")
def pca_embedding(s, d):
    return models.pca(A.survey(s, d), A.SURVEY).select("vec_id", "class_code", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("bootstrap_ci")
def bootstrap_ci(s, d):
    """1,000 replicates of the mean, in one pass over the rows."""
    return resample.mean(A.scores(s, d), "score", "id")
