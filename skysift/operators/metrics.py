"""Classification metrics as aggregations; an undefined ratio is 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rank import quantiles


def ratio(a: Column, b: Column, other: float = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(other)


def binary(df: DataFrame, y: str = "y", p: str = "pred_a", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., tp, fp, fn, tn, accuracy, precision, recall, f1, mcc)."""
    hit = lambda t, q: F.sum(((F.col(y) == t) & (F.col(p) == q)).cast("long"))
    c = df.groupBy(*by).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        *by, "tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    )


def confusion(df: DataFrame, t: str = "t", p: str = "p") -> DataFrame:
    """(t, p, n, share of the true class)."""
    c = df.groupBy(F.col(t).alias("t"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("t")))


def per_class(df: DataFrame, t: str = "t", p: str = "p") -> DataFrame:
    """(class_code, support, predicted, hits, precision, recall, f1) of every
    class that is true or predicted somewhere."""
    c = confusion(df, t, p)
    true = c.groupBy(F.col("t").alias("class_code")).agg(F.sum("n").alias("support"))
    pred = c.groupBy(F.col("p").alias("class_code")).agg(F.sum("n").alias("predicted"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    j = true.join(pred, "class_code", "full").na.fill(0)
    s, q, h = (F.col(x).cast("double") for x in ("support", "predicted", "hits"))
    return j.select("class_code", "support", "predicted", "hits", ratio(h, q).alias("precision"), ratio(h, s).alias("recall"), ratio(2 * h, s + q).alias("f1"))


def multiclass(df: DataFrame, t: str = "t", p: str = "p") -> DataFrame:
    """One row: n, accuracy, balanced accuracy, macro and weighted F1, MCC."""
    k = per_class(df, t, p)
    a = k.agg(
        F.sum("support").alias("n"), F.sum("hits").alias("c"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"), F.sum(F.col("f1") * F.col("support")).alias("w"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("tp_"), F.sum(F.col("predicted").cast("double") ** 2).alias("pp"),
        F.sum(F.col("support").cast("double") ** 2).alias("tt"),
    )
    n, c = F.col("n").cast("double"), F.col("c").cast("double")
    return a.select(
        "n", ratio(c, n).alias("accuracy"), "balanced_accuracy", "macro_f1", ratio(F.col("w"), n).alias("weighted_f1"),
        ratio(c * n - F.col("tp_"), F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))).alias("mcc"),
    )


def mcnemar(df: DataFrame, y: str = "y", a: str = "pred_a", b: str = "pred_b") -> DataFrame:
    """(b01, b10, statistic): continuity-corrected; 0 without discord."""
    right_a, right_b = F.col(a) == F.col(y), F.col(b) == F.col(y)
    c = df.agg(F.count_if(~right_a & right_b).alias("b01"), F.count_if(right_a & ~right_b).alias("b10"))
    d = F.abs(F.col("b01") - F.col("b10")) - 1
    return c.withColumn("statistic", ratio(d.cast("double") * d, (F.col("b01") + F.col("b10")).cast("double")))


def chi2_1_tail(x: float) -> float:
    """Upper tail of chi-squared with one degree of freedom."""
    return math.erfc(math.sqrt(x / 2)) if x > 0 else 1.0


Z95 = 1.96


def wilson(df: DataFrame, correct: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, k, low, high): 95 % interval of a proportion."""
    c = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(correct).alias("k"))
    n, p = F.col("n").cast("double"), F.col("k") / F.col("n")
    z2 = Z95 * Z95
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return c.select(*by, "n", "k", (mid - half).alias("low"), (mid + half).alias("high"))


def role_rates(df: DataFrame, role: str = "true_role", verdict: str = "verdict") -> DataFrame:
    """(n_anomaly, n_control, tpr, fpr, passed): rates of flagged rows by role;
    unlabelled rows count nowhere, a missing class counts as perfect."""
    flagged = F.col(verdict) == "Anomaly"
    anomaly, control = F.col(role) == "Anomaly", F.col(role).isin("Natural", "Interference")
    c = df.agg(
        F.count_if(anomaly).alias("n_anomaly"), F.count_if(control).alias("n_control"), F.count_if(anomaly & flagged).alias("_t"), F.count_if(control & flagged).alias("_f")
    )
    tpr, fpr = ratio(F.col("_t"), F.col("n_anomaly"), 1.0), ratio(F.col("_f"), F.col("n_control"), 0.0)
    return c.select("n_anomaly", "n_control", tpr.alias("tpr"), fpr.alias("fpr"), ((tpr >= 0.9) & (fpr <= 0.1)).alias("passed"))


def calibration_curve(df: DataFrame, prob: str = "prob", y: str = "y", bins: int = 10) -> DataFrame:
    """(bin, n, mean_prob, rate): bins between the quantiles of prob."""
    edges = quantiles(df, (prob,), tuple(i / bins for i in range(1, bins))).select(F.array(*[f"q{i}" for i in range(bins - 1)]).alias("_e"))
    rows = df.join(F.broadcast(edges))  # one row
    rows = rows.withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col(prob))))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(prob).alias("mean_prob"), F.avg(F.col(y).cast("double")).alias("rate"))


def histogram(df: DataFrame, value: str, bins: int = 39, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(bin, n): equal widths between two quantiles; values outside are left
    out, the upper end belongs to the last bin."""
    edge = quantiles(df, (value,), (low, high)).select(F.col("q0").alias("_lo"), F.col("q1").alias("_hi"))
    rows = df.join(F.broadcast(edge)).where(F.col(value).between(F.col("_lo"), F.col("_hi")) & (F.col("_hi") > F.col("_lo")))
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def covariances(df: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., a, b, cov): sample covariance of every pair a <= b, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.groupBy(*by).agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("cov")) for a, b in pairs])
    return one.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def by_type(df: DataFrame, kind: str, score: str, flagged: Column) -> DataFrame:
    """(kind, n, ood_count, mean_score, min_score, ood_fraction)."""
    c = df.groupBy(F.col(kind).alias("kind")).agg(
        F.count("*").alias("n"), F.count_if(flagged).alias("ood_count"), F.avg(score).alias("mean_score"), F.min(score).alias("min_score")
    )
    return c.withColumn("ood_fraction", F.col("ood_count") / F.col("n"))
