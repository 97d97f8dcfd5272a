"""Physics-law scores in [0, 1]; what is unknown scores 0.5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEUTRAL = 0.5


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def technosignature(concentration: Column, flatness: Column, claimed_dispersed: Column) -> Column:
    """Narrow and tonal is high; a claim of dispersion raises it by a quarter."""
    base = clip(0.6 * F.coalesce(concentration, F.lit(0.0)) + 0.4 * (1 - F.coalesce(flatness, F.lit(1.0))))
    return F.when(claimed_dispersed, clip(base * 1.25)).otherwise(base)


def dispersion_excess(dm: Column, dm_gal_max: Column, claims_extragalactic: Column) -> Column:
    """How far a claim of distance is borne out by dispersion beyond the galaxy."""
    excess = dm - dm_gal_max
    score = F.when(excess <= 0, 0.0).otherwise(1 - F.exp(-excess / F.greatest(F.abs(dm_gal_max), F.lit(1e-12))))
    known = F.coalesce(claims_extragalactic, F.lit(False)) & dm.isNotNull() & dm_gal_max.isNotNull()
    return F.when(known, clip(score)).otherwise(NEUTRAL)


def duty_cycle(width_ms: Column, period_s: Column) -> Column:
    duty = width_ms / 1000 / period_s
    return F.when((width_ms > 0) & (period_s > 0), clip((duty - 0.001) / 0.014)).otherwise(NEUTRAL)


def combine(techno: Column, dispersion: Column, duty: Column, use_catalog: Column) -> Column:
    both = clip(0.7 * techno + 0.3 * (1 - (dispersion + duty) / 2))
    return F.when(use_catalog, both).otherwise(techno)
