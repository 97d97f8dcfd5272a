"""Fitted models as small tables, so that a later job scores without a fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .models import Mixture


def save_mixtures(spark: SparkSession, mixtures: dict, path: str) -> None:
    """One row per class and component."""
    rows = []
    for label, m in mixtures.items():
        for i, w in enumerate(m.weights):
            rows.append((
                str(label), i, list(m.columns), m.shift.tolist(), m.scale.tolist(), float(w), m.means[i].tolist(), m.covs[i].ravel().tolist()
            ))
    schema = "label string, component int, columns array<string>, shift array<double>, scale array<double>, weight double, mean array<double>, cov array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_mixtures(spark: SparkSession, path: str, label_type: type = str) -> dict:
    out: dict = {}
    rows = spark.read.parquet(path).orderBy("label", "component").collect()  # classes x components
    for label in dict.fromkeys(r["label"] for r in rows):
        own = [r for r in rows if r["label"] == label]
        d = len(own[0]["columns"])
        out[label_type(label)] = Mixture(
            tuple(own[0]["columns"]), np.array(own[0]["shift"]), np.array(own[0]["scale"]), np.array([r["weight"] for r in own]),
            np.array([r["mean"] for r in own]), np.array([np.reshape(r["cov"], (d, d)) for r in own]),
        )
    return out


def save_calibration(df: DataFrame, path: str, score: str = "score", by: str = "class_name") -> None:
    """Distinct calibration scores with their counts, sorted within files."""
    counts = df.groupBy(by, score).agg(F.count("*").alias("n"))
    counts.repartitionByRange(by, score).sortWithinPartitions(by, score).write.mode("overwrite").parquet(path)


def load_calibration(spark: SparkSession, path: str, score: str = "score") -> DataFrame:
    """The calibration rows again, one per score."""
    rows = spark.read.parquet(path)
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n", "_i")


def save_ensemble(model, path: str) -> None:
    """A fitted pipeline of assembler, scaler and ensemble."""
    model.write().overwrite().save(path)


def load_ensemble(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
