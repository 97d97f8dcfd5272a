"""Order statistics over large tables without a single-partition window.

The input is written once. Rows are dealt to ranges of the ordering value by
approximate quantiles, and one shuffle by group and range serves the running
sums; a row's cumulative sum is its range's sum so far plus the totals of the
ranges before it, which come from a small aggregate. The quantiles only balance
the work: results are exact whatever they are. The number of ranges follows from
the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import stored

#: Rows of a range, the most ranges (cuts are a literal), and the most rows of a
#: small table that is sent to all tasks.
RANGE_ROWS, MAX_RANGES, MAX_BROADCAST = 1_000_000, 4096, 100_000
#: Rows from which quantiles look near their points only, and the share of ranks
#: on either side that is near. Approximate quantiles err by a fifth of it at most.
NEAR_ROWS, NEAR = 500_000, 0.005


def beside(df: DataFrame, side: DataFrame, keys: list[str], small: bool | None = None) -> DataFrame:
    """Joins a stored table of a few numbers a row: by a broadcast if it has few
    rows (or where the caller knows that it is small), by a shuffle if not. Keys
    that are null meet each other: no row of df is lost to a null group."""
    own = side.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in side.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    small = side.count() <= MAX_BROADCAST if small is None else small
    return df.join(F.broadcast(own) if small else own, on).drop(*[f"_k_{k}" for k in keys])


def n_ranges(rows: int) -> int:
    return min(MAX_RANGES, max(1, math.ceil(rows / RANGE_ROWS)))


def ranged(df: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """Adds _range, the number of cuts below the row's order value. df must be a
    stored table: it is read more than once."""
    k = n_ranges(df.count())
    if k == 1:
        return df.withColumn("_range", F.lit(0))
    at = F.percentile_approx(order, F.array(*[F.lit(i / k) for i in range(1, k)]), F.lit(100 * k))
    cuts = df.groupBy(*keys).agg(at.alias("_cuts")) if keys else df.agg(at.alias("_cuts"))
    rows = beside(df, stored(cuts), keys) if keys else df.withColumn("_cuts", F.array(*[F.lit(c) for c in cuts.first()[0]]))
    return rows.withColumn("_range", _place(F.col("_cuts"), F.col(order), k)).drop("_cuts")


def _place(cuts: Column, value: Column, k: int) -> Column:
    """The number of sorted cuts below value, by two short scans: over every
    step-th cut and within the step."""
    step = max(1, math.isqrt(k))
    coarse = F.filter(cuts, lambda c, i: (i % step == step - 1) & (c < value))
    within = F.slice(cuts, F.size(coarse) * step + 1, step)
    return F.size(coarse) * step + F.size(F.filter(within, lambda c: c < value))


def cumulative(
    df: DataFrame, order: str, sums: dict[str, str], by: tuple[str, ...] = (), descending: bool = False, totals: dict[str, str] | None = None
) -> DataFrame:
    """Adds, for each (name, column) of sums, the sum of column over the rows of
    the same group whose order value is at most (descending: at least) the
    row's own; ties count in full. For each of totals it adds the group's sum."""
    keys, totals = list(by), totals or {}
    rows = ranged(stored(df), order, keys)
    named = {f"_t_{n}": c for n, c in (sums | totals).items()}
    part = stored(rows.groupBy(*keys, "_range").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in named.items()]))
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))  # a row for each range
    rank = F.col("_range").desc() if descending else F.col("_range").asc()
    before = group.orderBy(rank).rowsBetween(W.unboundedPreceding, -1)
    offsets = part.select(
        *keys, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(group).alias(n) for n in totals],
    )
    o = F.col(order).desc() if descending else F.col(order).asc()
    within = W.partitionBy(*keys, "_range").orderBy(o).rangeBetween(W.unboundedPreceding, W.currentRow)
    out = beside(rows, stored(offsets), [*keys, "_range"])
    for n, c in sums.items():
        out = out.withColumn(n, F.col(f"_o_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0)))
    return out.drop("_range", *[f"_o_{n}" for n in sums])


def quantiles(df: DataFrame, columns: tuple[str, ...], points: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., column, q0, q1 ...): exact quantiles, interpolated between the two
    nearest ranks, of the values of each column that are not null. Columns are
    put under each other, so one shuffle serves all; no task holds all values.
    In large tables only the values about each point are told apart: those that
    surely lie below or above it are counted."""
    df = stored(df.select(*by, *columns))
    if df.count() > NEAR_ROWS:
        return _near_quantiles(df, columns, points, by)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_v")
    long = df.select(*by, each).select(*by, "_v.*").where("value IS NOT NULL")
    keys = [*by, "column"]
    ties = long.groupBy(*keys, "value").agg(F.count("*").alias("_n"))
    rows = cumulative(ties, "value", {"_le": "_n"}, tuple(keys), totals={"_all": "_n"})
    out = []
    for i, q in enumerate(points):
        at = (F.col("_all") - 1) * F.lit(float(q))
        first, second = (F.min(F.when(F.col("_le") > f(at), F.col("value"))) for f in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        out.append((first + (second - first) * part).alias(f"q{i}"))
    return rows.groupBy(*keys).agg(*out)


def _near_quantiles(df: DataFrame, columns: tuple[str, ...], points: tuple[float, ...], by: tuple[str, ...]) -> DataFrame:
    """quantiles of a large table, in two passes: approximate quantiles on both
    sides of each point bound the ranks that it needs, since their error is
    bounded; values outside become minus or plus infinity and keep their number.
    Groups of few rows keep all values."""
    value = lambda c: F.col(c).cast("double")
    ends = F.array(*[F.lit(min(max(q + side, 0.0), 1.0)) for q in points for side in (-NEAR, NEAR)])
    accuracy = F.lit(round(5 / NEAR))
    found = [F.struct(F.count(value(c)).alias("n"), F.percentile_approx(value(c), ends, accuracy).alias("e")).alias(f"_e{i}") for i, c in enumerate(columns)]
    bounds = stored(df.groupBy(*by).agg(*found) if by else df.agg(*found))
    rows = beside(df, bounds, list(by)) if by else df.join(F.broadcast(bounds))  # one row
    inf = F.lit(float("inf"))
    each = []
    for i, c in enumerate(columns):
        few = F.col(f"_e{i}.n") < 2 / NEAR * 10
        for j in range(len(points)):
            lo, hi = (F.col(f"_e{i}.e")[2 * j + k] for k in range(2))
            near = F.when(few, value(c)).when(value(c) < lo, -inf).when(value(c) > hi, inf).otherwise(value(c))
            each.append(F.struct(F.lit(c).alias("column"), F.lit(j).alias("_j"), F.when(value(c).isNotNull(), near).alias("value")))
    keys = [*by, "column", "_j"]
    long = rows.select(*by, F.explode(F.array(*each)).alias("_v")).select(*by, "_v.*").where("value IS NOT NULL")
    ties = cumulative(long.groupBy(*keys, "value").agg(F.count("*").alias("_n")), "value", {"_le": "_n"}, tuple(keys), totals={"_all": "_n"})
    q = F.element_at(F.array(*[F.lit(float(x)) for x in points]), F.col("_j") + 1)
    at = (F.col("_all") - 1) * q
    first, second = (F.min(F.when(F.col("_le") > f(at), F.col("value"))) for f in (F.floor, F.ceil))
    part = F.max(at - F.floor(at))
    picked = ties.groupBy(*keys).agg((first + (second - first) * part).alias("q"))
    return picked.groupBy(*by, "column").agg(*[F.max(F.when(F.col("_j") == j, F.col("q"))).alias(f"q{j}") for j in range(len(points))])
