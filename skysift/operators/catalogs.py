"""Catalog operators: features, imputation, scaling, lookups and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import physical
from ..session import stored
from .rank import beside, quantiles, ranged

REQUIRED = ("object_id", "class_name", "dm", "dm_gal_max", "snr", "width_ms", "period_s", "glat")


class CatalogError(ValueError):
    """A catalog that cannot be featurized."""


def check(df: DataFrame) -> None:
    """Fails on missing columns, an empty catalog, and missing, infinite or
    negative dispersion measures; one aggregation."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise CatalogError(f"missing columns: {', '.join(missing)}")
    dm = F.col("dm")
    n, bad = df.agg(F.count("*"), F.count_if(dm.isNull() | F.isnan(dm) | (F.abs(dm) == float("inf")) | (dm < 0))).first()
    if not n:
        raise CatalogError("the catalog is empty")
    if bad:
        raise CatalogError(f"{bad} rows without a finite dispersion measure of 0 or more")


def featurize(df: DataFrame) -> DataFrame:
    """(object_id, class_name, the twelve features)."""
    return df.select("object_id", "class_name", *[c.cast("double").alias(n) if n in physical.CONTINUOUS else c.alias(n) for n, c in physical.features().items()])


def medians(df: DataFrame, columns: tuple[str, ...] = physical.CONTINUOUS) -> DataFrame:
    """One row: the exact median of each column, 0 if it has no value."""
    q = quantiles(df, columns, (0.5,))
    return q.agg(*[F.coalesce(F.max(F.when(F.col("column") == c, F.col("q0"))), F.lit(0.0)).alias(c) for c in columns])


def impute(df: DataFrame, med: DataFrame, columns: tuple[str, ...] = physical.CONTINUOUS) -> DataFrame:
    """Fills the continuous columns by the one row of medians."""
    m = med.select([F.col(c).alias(f"_m_{c}") for c in columns])
    return df.join(F.broadcast(m)).withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in columns}).drop(*m.columns)


def standardize(df: DataFrame, columns: tuple[str, ...], by: tuple[str, ...] = (), floor: float = 1e-12, instead: float = 1.0) -> DataFrame:
    """z-scores with population spread; a spread of at most floor counts as
    instead. Rows of a null group are a group. Moments come from one partial aggregation."""
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(1))
    m = rows.groupBy(*keys).agg(*[F.avg(c).alias(f"_a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    z = {c: (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") > floor, F.col(f"_s_{c}")).otherwise(instead) for c in columns}
    return beside(rows, stored(m) if by else m, keys, None if by else True).withColumns(z).drop(*[f"_{k}_{c}" for k in "as" for c in columns], *([] if by else ["_all"]))


def off_manifold(df: DataFrame, columns: tuple[str, ...] = physical.CONTINUOUS) -> DataFrame:
    """Adds score: minus the length of the standardised, imputed features, so
    the most unusual rows score lowest."""
    z = standardize(impute(df, medians(df)), columns)
    return z.withColumn("score", F.round(-F.sqrt(sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0]))), 6))


def top_k(df: DataFrame, order: str, k: int, id_col: str, descending: bool = False) -> DataFrame:
    o = F.col(order).desc() if descending else F.col(order).asc()
    return df.orderBy(o, id_col).limit(k)


def cluster_stats(df: DataFrame, label: str, columns: tuple[str, ...], moment: str) -> DataFrame:
    """(class, n, means, p5 and p95 of moment)."""
    means = df.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])
    ends = quantiles(df, (moment,), (0.05, 0.95), (label,)).select(label, F.col("q0").alias("p5"), F.col("q1").alias("p95"))
    return means.join(ends, label, "left")


def nearest(targets: DataFrame, pool: DataFrame, key: str, target_id: str, pool_id: str) -> DataFrame:
    """(target_id, key, nearest_id, nearest_key): the pool row with the closest
    key, of equals the smaller key, then the smaller id. Both sides are dealt
    together to ranges of the key (an as-of join both ways), not paired; a range
    takes the last pool row before it and the first one after it along."""
    one = pool.groupBy(key).agg(F.min(pool_id).alias(pool_id))  # the smallest id of each key
    mine = targets.select(F.col(target_id).alias("_t"), F.col(key).cast("double").alias("_k"), F.lit(None).cast("struct<k:double,i:bigint>").alias("_p"))
    theirs = F.struct(F.col(key).cast("double").alias("k"), F.col(pool_id).cast("bigint").alias("i"))
    both = stored(mine.unionByName(one.select(F.lit(None).alias("_t"), F.col(key).cast("double").alias("_k"), theirs.alias("_p"))))
    rows = ranged(both, "_k", [])
    ends = stored(rows.groupBy("_range").agg(F.min("_p").alias("_lo"), F.max("_p").alias("_hi")))
    order = W.partitionBy(F.lit(1)).orderBy("_range")  # a row for each range
    edges = ends.select(
        "_range", F.last("_hi", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
        F.first("_lo", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)).alias("_after"),
    )
    up = W.partitionBy("_range").orderBy(F.col("_k"), F.col("_p").isNull()).rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy("_range").orderBy(F.col("_k").desc(), F.col("_p").isNull()).rowsBetween(W.unboundedPreceding, 0)
    rows = beside(rows, stored(edges), ["_range"]).select(
        "_t", "_k", F.coalesce(F.last("_p", ignorenulls=True).over(up), "_before").alias("d"), F.coalesce(F.last("_p", ignorenulls=True).over(down), "_after").alias("u")
    )
    take_d = F.col("u").isNull() | (F.abs(F.col("_k") - F.col("d.k")) <= F.abs(F.col("u.k") - F.col("_k")))
    best = F.when(F.col("d").isNotNull() & take_d, F.col("d")).otherwise(F.col("u"))
    found = rows.where("_t IS NOT NULL")
    return found.select(F.col("_t").alias(target_id), F.col("_k").alias(key), best["i"].alias("nearest_id"), best["k"].alias("nearest_key"))


def fallback(df: DataFrame, side: DataFrame, key: str, column: str, default: Column) -> DataFrame:
    """Left join on key; column is default where the side has no row."""
    return df.join(side.select(key, column), key, "left").withColumn(column, F.coalesce(F.col(column), default))


def union_catalogs(*catalogs: DataFrame) -> DataFrame:
    out = catalogs[0]
    for c in catalogs[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def alias_classes(df: DataFrame, aliases: dict[str, str], column: str = "class_name") -> DataFrame:
    """Renames classes by a small fixed map; others keep their name."""
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))


def class_codes(df: DataFrame, label: str, id_col: str) -> DataFrame:
    """(label, code): codes in the order in which classes first appear."""
    first = df.groupBy(label).agg(F.min(id_col).alias("first_id"))
    return first.withColumn("code", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("first_id")) - 1).select(label, "code")
