"""Streaming: score events against a frozen calibration, count verdicts.

Scoring is stateless: a row's p comes from the calibration's quantile table, a
bounded side that does not grow with the stream. Counting is a watermarked
window. False discovery control needs all p-values of a batch and so runs in
foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import conformal

#: Points of a class's frozen calibration curve; p is exact to 1 / POINTS.
POINTS = 1000


def freeze(calibration: DataFrame, score: str = "score", by: str = "class_name") -> DataFrame:
    """(by, n, points): each class's calibration as POINTS quantiles."""
    at = F.array(*[F.lit((i + 0.5) / POINTS) for i in range(POINTS)])
    return calibration.groupBy(by).agg(F.count("*").alias("n"), F.percentile(score, at).alias("points"))


def score(stream: DataFrame, frozen: DataFrame, column: str = "score", by: str = "class_name") -> DataFrame:
    """Adds p: low-tail conformal p from the frozen curve; 1 without one."""
    rows = stream.join(frozen, by, "left")
    below = F.size(F.filter("points", lambda x: x <= F.col(column))) / float(POINTS)
    return rows.withColumn("p", F.coalesce((below * F.col("n") + 1) / (F.col("n") + 1), F.lit(1.0))).drop("points", "n")


def verdict_counts(scored: DataFrame, ts: str = "ts", alpha: float = 0.05, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """(start, class_name, n, flagged) per window; rows later than the
    watermark are left out. Timestamps without a zone are taken as UTC."""
    rows = scored.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, window).alias("w"), "class_name").agg(F.count("*").alias("n"), F.count_if(F.col("p") < alpha).alias("flagged"))
    return out.select(F.col("w.start").alias("start"), "class_name", "n", "flagged")


def discoveries(write: Callable[[DataFrame, int], None], alpha: float = 0.1) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that controls false discoveries in each batch
    and hands the rows with ``rejected`` to write."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write(conformal.bh(batch, alpha), batch_id)

    return run
