"""Curated signals on the survey's manifold: a saved density, a ranked table of
scores, p-values and verdicts, totals by type, and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conformal, metrics, models, persist, rank, splits
from ..session import stored

COMPONENTS, SHARE, MARGIN = 5, 0.7, 5.0
OFF, ON = "OOD", "on-manifold"


@dataclass
class Manifold:
    """Densities of the survey's classes, the least density of the rows that they
    were fitted on, and the densities of the rows that they never saw."""

    mixtures: dict
    floor: float
    calibration: DataFrame

    @classmethod
    def fit(cls, survey: DataFrame, columns: tuple[str, ...], label: str = "y", id_col: str = "vec_id") -> Manifold:
        """70 % of all rows are fitted on, in the order of the ids' digests."""
        rows = stored(splits.fit_calibration(survey.withColumn("_all", F.lit(1)), id_col, "_all", SHARE))
        mix = models.fit_mixtures(rows.where("is_fit = 1"), label, columns, COMPONENTS)
        scored = stored(models.log_prob(rows, mix).select("is_fit", F.round("log_prob", 6).alias("score")))
        floor = scored.where("is_fit = 1").agg(F.min("score")).first()[0]
        return cls(mix, float(floor), scored.where("is_fit = 0").select("score"))

    def save(self, path: str) -> None:
        spark = self.calibration.sparkSession
        persist.save_mixtures(spark, self.mixtures, f"{path}/mixtures")
        persist.save_calibration(self.calibration.withColumn("class_name", F.lit("all")), f"{path}/calibration")
        spark.createDataFrame([(self.floor,)], "floor double").coalesce(1).write.mode("overwrite").parquet(f"{path}/floor")

    @classmethod
    def load(cls, spark: SparkSession, path: str, label_type: type = int) -> Manifold:
        floor = spark.read.parquet(f"{path}/floor").first()[0]
        return cls(persist.load_mixtures(spark, f"{path}/mixtures", label_type), floor, persist.load_calibration(spark, f"{path}/calibration").select("score"))


def audit(curated: DataFrame, manifold: Manifold, features: tuple[str, ...], margin: float = MARGIN) -> DataFrame:
    """The curated rows with score, p (low tail against the calibration), verdict
    and rank: 1 for the rarest, equal scores sharing the best of their ranks.
    features: the curated columns in the order of the density's."""
    own = tuple(next(iter(manifold.mixtures.values())).columns)
    named = curated.withColumns({c: F.col(f).cast("double") for c, f in zip(own, features, strict=True)})
    scored = models.log_prob(named, manifold.mixtures).withColumn("score", F.round("log_prob", 6))
    rows = stored(scored.select(*curated.columns, "score"))
    ties = rows.groupBy("score").agg(F.count("*").alias("copies"), F.lit(0).alias("is_cal"))
    null = manifold.calibration.select("score", F.lit(0).cast("long").alias("copies"), F.lit(1).alias("is_cal"))
    p = conformal.low_tail(ties.unionByName(null)).where("copies > 0").select("score", "p", "copies")
    placed = rank.cumulative(p, "score", {"upto": "copies"})
    side = stored(placed.select("score", "p", (F.col("upto") - F.col("copies") + 1).alias("rank")))
    verdict = F.when(F.col("score") < manifold.floor - margin, OFF).otherwise(ON)
    return rank.beside(rows, side, ["score"]).withColumn("verdict", verdict)


def by_type(rows: DataFrame) -> DataFrame:
    """(kind, n, ood_count, mean_score, min_score, ood_fraction)."""
    return metrics.by_type(rows, "kind", "score", F.col("verdict") == OFF)


def report(rows: DataFrame, top: int = 20) -> str:
    """Markdown: totals, totals by type, and the top rarest signals (a top-k
    table; every signal is in rows)."""
    n, off = rows.agg(F.count("*"), F.count_if(F.col("verdict") == OFF)).first()
    lines = ["# Curated signals", "", f"{off} of {n} signals lie off the manifold.", "", "| Type | Signals | Off | Mean score | Least score |", "|---|---|---|---|---|"]
    for r in by_type(rows).orderBy("kind").collect():  # a row for each type
        lines.append(f"| {r['kind']} | {r['n']} | {r['ood_count']} | {r['mean_score']:.2f} | {r['min_score']:.2f} |")
    lines += ["", "| Rank | Name | Type | Score | p | Verdict |", "|---|---|---|---|---|---|"]
    for r in rows.orderBy("rank", "name").limit(top).collect():
        lines.append(f"| {r['rank']} | {r['name']} | {r['kind']} | {r['score']:.2f} | {r['p']:.4f} | {r['verdict']} |")
    return "\n".join(lines) + "\n"
