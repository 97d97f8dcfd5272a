"""Column expressions of the physical catalog features; missing is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTINUOUS = ("log_dm", "dm_excess", "dm_excess_ratio", "abs_glat", "log_width", "log_snr", "log_period", "log_duty")
INDICATORS = ("has_glat", "has_width", "has_snr", "has_period")


def features() -> dict[str, Column]:
    """The twelve features of a catalog row, by name."""
    dm, gal, snr, glat = F.col("dm"), F.coalesce("dm_gal_max", "dm"), F.col("snr"), F.col("glat")
    width, period = F.col("width_ms"), F.col("period_s")
    return {
        "log_dm": F.log10(dm + 1),
        "dm_excess": dm - gal,
        "dm_excess_ratio": dm / (1 + F.greatest(gal, F.lit(0.0))),
        "abs_glat": F.abs(glat),
        "log_width": F.when(width > 0, F.log10(F.greatest(width, F.lit(1e-12)))),
        "log_snr": F.when(snr.isNotNull(), F.log10(F.greatest(snr, F.lit(0.0)) + 1)),
        "log_period": F.when(period > 0, F.log10(period)),
        "log_duty": F.when((width > 0) & (period > 0), F.log10(width / 1000 / period)),
        "has_glat": glat.isNotNull().cast("int"),
        "has_width": F.coalesce(width > 0, F.lit(False)).cast("int"),
        "has_snr": snr.isNotNull().cast("int"),
        "has_period": F.coalesce(period > 0, F.lit(False)).cast("int"),
    }


def snr_to_moment(snr: Column, lo: Column | float, hi: Column | float) -> Column:
    """Maps a signal-to-noise ratio to [lo, hi] on a square-root scale that is
    linear in two halves, joined at 10; missing goes to the middle."""
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    s = F.sqrt(F.least(F.greatest(snr, F.lit(1.0)), F.lit(100.0)))
    ten = F.sqrt(F.lit(10.0))
    share = F.when(s <= ten, (s - 1) / (ten - 1) / 2).otherwise(0.5 + (s - ten) / (10 - ten) / 2)
    return F.when(snr.isNull() | F.isnan(snr), (lo + hi) / 2).otherwise(lo + share * (hi - lo))
