"""Reproducible splits: ranks by a hash of the id, never a random generator.

A rank within a class needs no window over the class. Digests are even by nature,
so their leading bits deal a class to ranges of like size, without quantiles; a
row's rank is its place within its range (one shuffle by class and range) plus the
rows of the ranges before, which a small table of counts tells. The number of
ranges follows from the number of rows, and splits are the same for any number.
Rows of a null class are a class; equal ids stay neighbours in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored
from . import rank

SEED = 42


def split_key(id_col: str, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed))))


def hashed_fraction(id_col: str, seed: int = SEED) -> Column:
    """A number in [0, 1) by the id's hash; for splits that need no exact size
    this assigns rows without any shuffle."""
    return _leading(split_key(id_col, seed)) / float(1 << 32)


def _leading(key: Column) -> Column:
    """The first 32 bits of a digest."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double")


def ranked(df: DataFrame, id_col: str, label: str, seed: int = SEED) -> DataFrame:
    """Adds _i, the row's rank from 0 within its class in the order of the ids'
    digests, and _n, the rows of the class."""
    rows = stored(df.withColumn("_key", split_key(id_col, seed)))
    ranges = -(-max(1, rows.count()) // rank.RANGE_ROWS)
    rows = rows.withColumn("_range", F.floor(_leading(F.col("_key")) / float(1 << 32) * ranges).cast("int"))
    counts = stored(rows.groupBy(label, "_range").agg(F.count("*").alias("_c")))
    of_class = W.partitionBy(label)  # a row for each range
    before = F.coalesce(F.sum("_c").over(of_class.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = stored(counts.select(label, "_range", before.alias("_before"), F.sum("_c").over(of_class).alias("_n")))
    within = W.partitionBy(label, "_range").orderBy("_key", id_col)
    out = rank.beside(rows.withColumn("_at", F.row_number().over(within) - 1), offsets, [label, "_range"])
    return out.withColumn("_i", F.col("_before") + F.col("_at")).drop("_key", "_range", "_at", "_before")


def stratified(df: DataFrame, id_col: str, label: str, train: float = 0.8, val: float = 0.1, seed: int = SEED) -> DataFrame:
    """Adds split (train, val, test) with exact shares of each class."""
    rows = ranked(df, id_col, label, seed)
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * (train + val))
    return rows.withColumn("split", F.when(F.col("_i") < a, "train").when(F.col("_i") < b, "val").otherwise("test")).drop("_i", "_n")


def fit_calibration(df: DataFrame, id_col: str, label: str, share: float = 0.7, seed: int = SEED) -> DataFrame:
    """Adds is_fit: per class the first max(1, floor(share n)) rows."""
    rows = ranked(df, id_col, label, seed)
    return rows.withColumn("is_fit", (F.col("_i") < F.greatest(F.lit(1), F.floor(F.col("_n") * share))).cast("int")).drop("_i", "_n")


def kfold(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Adds fold 0 .. k - 1, each class spread evenly; k is at most the size of
    the least class and at least 2."""
    rows = ranked(df, id_col, label, seed)
    least = rows.groupBy(label).agg(F.first("_n").alias("_n")).agg(F.min("_n").alias("_m"))
    folds = F.greatest(F.lit(2), F.least(F.lit(k), F.col("_m")))
    return rows.join(F.broadcast(least)).withColumn("fold", (F.col("_i") % folds).cast("int")).drop("_i", "_n", "_m")  # one row


def group_kfold(df: DataFrame, group: str, label: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """Adds fold; all rows of a group share one. A group counts for its most
    frequent label (the smallest of equals)."""
    per = df.groupBy(group, label).agg(F.count("*").alias("_c"))
    main = per.groupBy(group).agg(F.max(F.struct("_c", (-F.col(label)).alias("_l")))["_l"].alias("_l"))
    folds = kfold(main.withColumn("_main", -F.col("_l")).drop("_l"), group, "_main", k, seed)
    return rank.beside(df, stored(folds.select(group, "fold")), [group])
