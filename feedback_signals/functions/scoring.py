"""Column expressions that score and flag classified rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import config as C
from .labels import as_number, broad_sentiment, coarse_polarity

POLARITIES = {"prefix": coarse_polarity, "broad": broad_sentiment}


def is_one_of(value: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(value.isin(*names), F.lit(False)) if names else F.lit(False)


def mismatch_type(
    prediction: Column,
    rating: Column,
    high: float = C.DEFAULTS.high_rating,
    low: float = C.DEFAULTS.low_rating,
    polarity: str = "broad",
) -> Column:
    """``""`` when rating and wording agree or the rating is unknown."""
    r, tone = as_number(rating), POLARITIES[polarity](prediction)
    return (
        F.when(prediction.isNull(), "")  # a text without a label contradicts no rating
        .when((r >= high) & (tone != C.POSITIVE), "HIGH_MISMATCH")
        .when((r <= low) & (tone == C.POSITIVE), "REVERSE_MISMATCH")
        .otherwise("")
    )


def is_real_minority(flag: Column, category: Column, require_nonempty: bool = False) -> Column:
    """Flagged for a reason other than being a statistical outlier."""
    cat = F.coalesce(category, F.lit(""))
    real = F.coalesce(flag, F.lit(False)) & ~F.contains(cat, F.lit(C.OUTLIER_ONLY))
    return real & (cat != "") if require_nonempty else real


def priority_score(
    prediction: Column,
    real_minority: Column,
    confidence: Column,
    tiers: C.Tiers = C.DEFAULTS.tiers,
    boost_below: float = C.DEFAULTS.boost_below,
) -> Column:
    base = (
        F.when(real_minority, 10)
        .when(is_one_of(prediction, tiers.high), 9)
        .when(is_one_of(prediction, tiers.medium), 7)
        .when(is_one_of(prediction, tiers.deprioritized), 1)
        .otherwise(5)
    )
    boost = F.when(confidence < boost_below, 1).otherwise(0)
    return F.least(F.lit(10), base + boost)


def confidence_band(
    confidence: Column,
    edges: tuple[float, float] = (0.9, 0.7),
    names: tuple[str, str, str] = ("high", "mid", "low"),
) -> Column:
    c = F.coalesce(confidence, F.lit(0.0))
    return F.when(c >= edges[0], names[0]).when(c >= edges[1], names[1]).otherwise(names[2])
