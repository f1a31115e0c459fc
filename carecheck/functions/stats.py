"""Column functions for scores, shares and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carecheck import rule_values as rv


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval of k out of n as fractions; (0, 0) where n is not positive."""
    z2 = rv.WILSON_Z * rv.WILSON_Z
    total = n.cast("double")
    p = k.cast("double") / F.nullif(total, F.lit(0.0))
    scale = 1 + F.lit(z2) / total
    centre = (p + F.lit(z2) / (2 * total)) / scale
    half = F.lit(rv.WILSON_Z) * F.sqrt(p * (1 - p) / total + F.lit(z2) / (4 * total * total)) / scale
    none = n <= 0
    low = F.when(none, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(none, F.lit(0.0)).otherwise(F.least(F.lit(1.0), centre + half))
    return low, high


def coverage_pct(k: Column, n: Column) -> Column:
    share = k.cast("double") / F.greatest(n, F.lit(1)).cast("double")
    return F.round(share * 100, 2)


def deficit(coverage: Column, n: Column) -> Column:
    """Facilities lacking the specialty, from the rounded coverage."""
    return F.round((100 - coverage) / 100 * n.cast("double"), 2)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, 0 where the whole is empty."""
    share = 100 * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.coalesce(F.round(share, digits), F.lit(0.0))


def trust01(score: Column) -> Column:
    """Score 0..100 clamped and rescaled to 0..1."""
    clamped = F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(score, F.lit(0))))
    return F.round(clamped.cast("double") / 100, 2)


def trust_tier(score01: Column) -> Column:
    return (
        F.when(score01 >= rv.TIER_HIGH, "High")
        .when(score01 >= rv.TIER_MODERATE, "Moderate")
        .otherwise("Low")
    )


def trust_components(
    capability: Column, equipment: Column, flags: Column, fill: list[Column]
) -> dict[str, Column]:
    """The five parts of the trust breakdown, each rounded to two digits."""
    listed = (F.size(capability) + F.size(equipment)).cast("double")
    high = F.size(F.filter(flags, lambda f: F.upper(f["severity"]) == "HIGH"))
    filled = sum((F.when(c.isNotNull() & (c.cast("string") != ""), 1).otherwise(0) for c in fill), F.lit(0))
    return {
        "claim_density": F.round(F.least(F.lit(1.0), listed / 20), 2),
        "evidence_agreement": F.when(F.size(equipment) > 0, F.lit(0.95)).otherwise(F.lit(0.30)),
        "contradiction_penalty": F.round(
            F.greatest(F.lit(0.0), 1 - F.lit(0.18) * F.size(flags).cast("double")), 2
        ),
        "location_coherence": F.round(
            F.greatest(F.lit(0.30), F.lit(0.95) - F.lit(0.20) * high.cast("double")), 2
        ),
        "structured_fillrate": F.round(filled.cast("double") / len(fill), 2),
    }
