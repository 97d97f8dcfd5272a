"""Conformal p-values, thresholds, false discovery control and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .rank import beside, cumulative


def _flagged(df: DataFrame, flag: str) -> DataFrame:
    return df.withColumn("_cal", F.col(flag).cast("long"))


def low_tail(df: DataFrame, score: str = "score", flag: str = "is_cal", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds p = (1 + calibration scores at most the score) / (1 + N)."""
    rows = cumulative(_flagged(df, flag), score, {"_le": "_cal"}, by, totals={"_n": "_cal"})
    return rows.withColumn("p", (F.col("_le") + 1) / (F.col("_n") + 1)).drop("_le", "_n", "_cal")


def high_tail(df: DataFrame, score: str = "score", flag: str = "is_cal", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds p = (1 + null scores at least the score) / (1 + n)."""
    rows = cumulative(_flagged(df, flag), score, {"_ge": "_cal"}, by, descending=True, totals={"_n": "_cal"})
    return rows.withColumn("p", (F.col("_ge") + 1) / (F.col("_n") + 1)).drop("_ge", "_n", "_cal")


def leave_one_out(df: DataFrame, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds p = scores at least the own one (itself included) / n."""
    rows = df.withColumn("_one", F.lit(1).cast("long"))
    rows = cumulative(rows, score, {"_ge": "_one"}, by, descending=True, totals={"_n": "_one"})
    return rows.withColumn("p", F.col("_ge") / F.col("_n")).drop("_ge", "_n", "_one")


def over_classes(df: DataFrame, score: str = "score", flag: str = "is_cal", label: str = "class_name", every: bool = False) -> DataFrame:
    """Per row that does not calibrate (every: per row, with its own class and
    score): the least and largest p over all classes' calibration scores and the
    class of the least (first by name)."""
    rows = stored(df)
    names = rows.where(F.col(flag) == 1).select(label).distinct().where(F.col(label).isNotNull()).orderBy(label).collect()  # class names, not rows
    own = ["id", label, score] if every else ["id"]
    if not names:
        none = F.lit(None).cast("double")
        return rows.limit(0).select(*own, none.alias("p_min"), none.alias("p_max"), F.col(label).alias("assigned"))
    # one order of all rows serves every class: a column of running counts for each
    one = {f"_c{i}": ((F.col(flag) == 1) & F.col(label).eqNullSafe(F.lit(r[0]))).cast("long") for i, r in enumerate(names)}
    k = range(len(names))
    rows = cumulative(rows.withColumns(one), score, {f"_le{i}": f"_c{i}" for i in k}, totals={f"_n{i}": f"_c{i}" for i in k})
    p = F.array(*[F.struct(((F.col(f"_le{i}") + 1) / (F.col(f"_n{i}") + 1)).alias("p"), F.lit(names[i][0]).alias("c")) for i in k])
    rows = rows if every else rows.where(F.col(flag) == 0)
    least = rows.select(*own, p.alias("_p")).select(*own, F.array_min("_p").alias("_min"), F.array_max("_p")["p"].alias("_max"))
    return least.groupBy("id").agg(
        *[F.first(c).alias(c) for c in own[1:]], F.min("_min")["p"].alias("p_min"), F.max("_max").alias("p_max"), F.min("_min")["c"].alias("assigned")
    )


def over_scores(df: DataFrame, scores: tuple[str, ...], flag: str = "is_cal", id_col: str = "vec_id") -> DataFrame:
    """Adds p_min and p_max: the least and largest low-tail p over several
    scores of a row (id_col tells rows apart), each against that score of all
    calibration rows. The scores are put under each other and ranked at once."""
    rows = stored(df)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).alias("value")) for c in scores])).alias("v")
    p = low_tail(rows.select(id_col, flag, each).select(id_col, flag, "v.*"), "value", flag, ("which",))
    return rows.join(p.groupBy(id_col).agg(F.min("p").alias("p_min"), F.max("p").alias("p_max")), id_col)


def threshold_rank(n: Column, alpha: float) -> Column:
    """0-based rank of the conformal threshold among n sorted scores."""
    k = F.ceil((1 - alpha) * (n + 1)).cast("long") - 1
    return F.least(F.greatest(k, F.lit(0).cast("long")), n - 1)


def _ranked(df: DataFrame, score: str, by: tuple[str, ...]) -> DataFrame:
    """Adds _le (scores of the group at most the own one) and n."""
    rows = df.select(*by, F.col(score).alias(score), F.lit(1).cast("long").alias("_one"))
    return cumulative(rows, score, {"_le": "_one"}, by, totals={"n": "_one"})


def thresholds(df: DataFrame, alpha: float, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, threshold): the order statistic at the conformal rank."""
    hit = _ranked(df, score, by).where(F.col("_le") > threshold_rank(F.col("n"), alpha))
    return hit.groupBy(*by).agg(F.max("n").alias("n"), F.min(score).alias("threshold"))


def loo_flag_rate(df: DataFrame, alpha: float, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, flagged, rate): scores above the threshold of the others.
    Taking out the score of rank r leaves the k-th of the rest at s[k] if r > k
    and at s[k + 1] if not, so one threshold pair serves all rows."""
    k = threshold_rank(F.col("n") - 1, alpha)
    ties = _ranked(df, score, by).groupBy(*by, score).agg(F.count("*").alias("c"), F.first("_le").alias("_le"), F.first("n").alias("n"))
    ties = stored(ties)
    cuts = stored(ties.groupBy(*by).agg(F.min(F.when(F.col("_le") > k, F.col(score))).alias("_at")))
    # scores above s[k] have a rank above k and are held against s[k]; the others cannot exceed s[k + 1]
    rows = beside(ties, cuts, list(by)) if by else ties.join(F.broadcast(cuts))  # one row
    out = rows.groupBy(*by).agg(F.max("n").alias("n"), F.sum(F.when(F.col(score) > F.col("_at"), F.col("c")).otherwise(0)).alias("flagged"))
    return out.withColumn("rate", F.col("flagged") / F.col("n"))


def bh(df: DataFrame, alpha: float, p: str = "p", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds rejected: Benjamini-Hochberg at level alpha. Only the p-values are
    ranked; the rows are held against their group's cut."""
    rows = stored(df)
    ties = rows.groupBy(*by, p).agg(F.count("*").alias("_c"))
    ranks = cumulative(ties, p, {"_rank": "_c"}, by, totals={"_n": "_c"})
    cut = ranks.groupBy(*by).agg(F.max(F.when(F.col(p) * F.col("_n") <= alpha * F.col("_rank"), F.col(p))).alias("_cut"))
    out = beside(rows, stored(cut), list(by)) if by else rows.join(F.broadcast(cut), how="left")  # one row
    return out.withColumn("rejected", F.coalesce(F.col(p) <= F.col("_cut"), F.lit(False))).drop("_cut")


def _ties(df: DataFrame, score: str, positive: str, by: tuple[str, ...] = ()) -> DataFrame:
    y = F.col(positive).cast("long")
    return df.groupBy(*by, score).agg(F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg"))


def auroc(df: DataFrame, score: str = "score", positive: str = "y", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n_pos, n_neg, auroc): Mann-Whitney with average ranks for ties."""
    return auroc_of(_ties(df, score, positive, by), score, by)


def auroc_of(ties: DataFrame, score: str = "score", by: tuple[str, ...] = ()) -> DataFrame:
    """auroc from (by..., score, _pos, _neg): weights of both classes by score."""
    ranked = cumulative(ties, score, {"_below": "_neg"}, by)
    won = ranked.withColumn("_won", F.col("_pos") * (F.col("_below") - F.col("_neg") / 2))
    out = won.groupBy(*by).agg(F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"), F.sum("_won").alias("_w"))
    return out.withColumn("auroc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_w") / (F.col("n_pos") * F.col("n_neg")))).drop("_w")


def roc(df: DataFrame, score: str = "score", positive: str = "y") -> DataFrame:
    """(threshold, tp, fp, tpr, fpr, precision): one row per distinct score."""
    sums = {"tp": "_pos", "fp": "_neg"}
    rows = cumulative(_ties(df, score, positive), score, sums, descending=True, totals={"_p": "_pos", "_n": "_neg"})
    return rows.select(
        F.col(score).alias("threshold"), "tp", "fp", (F.col("tp") / F.nullif("_p", F.lit(0))).alias("tpr"),
        (F.col("fp") / F.nullif("_n", F.lit(0))).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), "_pos", "_p",
    )


def average_precision(df: DataFrame, score: str = "score", positive: str = "y") -> DataFrame:
    """(n_pos, average_precision): precision weighted by the recall that each
    distinct score adds."""
    rows = roc(df, score, positive)
    return rows.agg(F.max("_p").alias("n_pos"), F.sum(F.col("precision") * F.col("_pos") / F.col("_p")).alias("average_precision"))
