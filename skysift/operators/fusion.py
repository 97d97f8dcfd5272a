"""Fusion of evidence and the verdict on each signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import laws
from .conformal import bh
from .waterfall import narrowband

#: Fixed verdict names.
NATURAL, INTERFERENCE, ANOMALY, CANDIDATE = "Natural", "Interference", "Anomaly", "Candidate — Requires Review"


def bonferroni(a: Column, b: Column) -> Column:
    return F.least(F.lit(1.0), 2 * a, 2 * b)


def fisher(a: Column, b: Column) -> Column:
    """Fisher's method for two p-values: the tail of chi-squared with four
    degrees of freedom in closed form; 0 if either is 0."""
    half = -(F.log(a) + F.log(b))
    return F.when((a <= 0) | (b <= 0), 0.0).otherwise(F.exp(-half) * (1 + half))


def smallest(a: Column, b: Column) -> Column:
    return F.least(a, b)


def combine_probs(meta: list[Column], other: list[Column]) -> list[Column]:
    """Geometric mean per class, renormalised; meta where other is unusable."""
    usable = other[0].isNotNull()
    for c in other:
        usable = usable & c.isNotNull() & ~F.isnan(c)
    g = [F.sqrt(F.greatest(m * c, F.lit(1e-12))) for m, c in zip(meta, other, strict=True)]
    total = g[0] + g[1] + g[2]
    return [F.when(usable, x / total).otherwise(m) for x, m in zip(g, meta, strict=True)]


def three_classes(p_pulsar: Column, p_rfi: Column, p_fused: Column) -> tuple[list[Column], Column]:
    """(probabilities, class code): the anomaly's is 1 - p; first largest."""
    a = 1 - p_fused
    code = F.when((p_pulsar >= p_rfi) & (p_pulsar >= a), 0).when(p_rfi >= a, 1).otherwise(2)
    return [p_pulsar, p_rfi, a], code


def with_evidence(df: DataFrame) -> DataFrame:
    """Adds p, pred (kept where it is given), the law scores and composite. Needs
    p_h, p_d, p0..p2, chaos and the physics columns; what is missing is neutral.
    The narrowband term is the score of the row's descriptors."""
    p = F.least("p_h", F.coalesce("p_d", F.lit(1.0)))
    pred = F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0).when(F.col("p1") >= F.col("p2"), 1).otherwise(2)
    rows = df.withColumn("p", p)
    rows = rows if "pred" in df.columns else rows.withColumn("pred", pred)
    claimed = F.col("pred").isin(0, 2) & (F.col("p0") + F.col("p2") >= 0.8)
    finite = F.col("dm").isNotNull() & ~F.isnan("dm") & (F.abs("dm") < float("inf"))
    catalog = finite | (F.col("width_ms").isNotNull() & F.col("period_s").isNotNull())
    techno = laws.technosignature(F.col("concentration"), F.col("spectral_flatness"), claimed)
    spread = laws.dispersion_excess(F.col("dm"), F.col("dm_gal_max"), F.col("is_extragalactic"))
    duty = laws.duty_cycle(F.col("width_ms"), F.col("period_s"))
    rows = rows.withColumn("physics", laws.combine(techno, spread, duty, catalog))
    rows = rows.withColumn("order_score", laws.clip(F.coalesce(1 - F.col("chaos"), F.lit(0.5))))
    narrow = F.coalesce(narrowband(df.columns), F.lit(0.5))
    strength = F.least(F.lit(50.0), -10 * F.log10(F.greatest("p", F.lit(1e-5))))
    mean = (F.col("p2") + F.col("order_score") + narrow + F.col("physics")) / 4
    return rows.withColumn("composite", F.round(laws.clip(strength + 50 * mean, 0.0, 100.0), 6))


def arbitrate(df: DataFrame, alpha: float = 0.05, fdr: float = 0.1, id_col: str = "signal_id") -> DataFrame:
    """Adds rejected (Benjamini-Hochberg over all rows) and verdict. In order:
    off the manifold or p < alpha is an anomaly; a sure class is that class if
    the physics agrees and a candidate if not; then discoveries, anomaly class
    or a high composite are candidates; the rest goes by class."""
    rows = bh(with_evidence(df), fdr, "p")
    sure = F.greatest("p0", "p1") >= 0.8
    verdict = (
        F.when(F.col("ood_mask") | (F.col("p") < alpha), ANOMALY)
        .when(sure & (F.col("physics") < 0.6), F.when(F.col("pred") == 0, NATURAL).otherwise(INTERFERENCE))
        .when(sure, CANDIDATE)
        .when(F.col("rejected") | (F.col("pred") == 2) | (F.col("composite") >= 50), CANDIDATE)
        .when(F.col("pred") == 1, INTERFERENCE)
        .otherwise(NATURAL)
    )
    return rows.withColumn("verdict", verdict)
