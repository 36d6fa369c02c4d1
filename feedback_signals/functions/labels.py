"""Column expressions that map ratings and labels to each other."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from .. import config as C
from .text import strip


def as_number(value: Column) -> Column:
    """Lenient number: what cannot be read, and NaN, is null."""
    return F.nullif(value.try_cast("double"), F.lit(float("nan")))


def rating_to_sentiment(rating: Column, low: float = 2.5, high: float = 3.8) -> Column:
    r = as_number(rating)
    return (
        F.when(r.isNull(), None).when(r < low, C.NEGATIVE).when(r < high, C.NEUTRAL)
        .otherwise(C.POSITIVE)
    )


def cut_to_sentiment(rating: Column, lower: Column, upper: Column) -> Column:
    r = as_number(rating)
    return (
        F.when(r.isNull(), None).when(r <= lower, C.NEGATIVE).when(r <= upper, C.NEUTRAL)
        .otherwise(C.POSITIVE)
    )


def ternary_to_sentiment(rating: Column) -> Column:
    r = as_number(rating)
    return (
        F.when(r.isNull(), None).when(r < 0, C.NEGATIVE).when(r == 0, C.NEUTRAL)
        .otherwise(C.POSITIVE)
    )


def quality_to_rating(quality: Column, missing_is_low: bool = True) -> Column:
    """1-5 quality to -1/0/1; null when the value is not a number.

    A missing value counts as low, as it does where a missing number is NaN and
    fails every comparison; ``missing_is_low=False`` keeps it null instead.
    """
    q = quality.try_cast("double")
    missing = quality.isNull() | F.isnan(q)
    return (
        F.when(missing, -1 if missing_is_low else None)
        .when(q >= 4, 1).when(q >= 3, 0).when(q.isNotNull(), -1)
    )


def rating_bucket(rating: Column) -> Column:
    r = as_number(rating)
    return F.when(r > 0, "positive").when(r < 0, "negative").otherwise("neutral")


def mapped(value: Column, mapping: Mapping[str, str]) -> Column:
    """Dictionary lookup; null when the key is unknown."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.create_map(*pairs)[value] if pairs else F.lit(None).cast("string")


def seed_label(emotional_label: Column) -> Column:
    return mapped(strip(F.lower(emotional_label)), C.SEED_LABELS)


def _starts_with_any(value: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(value, F.lit(p)) for p in prefixes])


def broad_sentiment(label: Column) -> Column:
    l = F.lower(label)
    return (
        F.when(_starts_with_any(l, C.POSITIVE_PREFIXES), C.POSITIVE)
        .when(_starts_with_any(l, C.NEGATIVE_PREFIXES), C.NEGATIVE)
        .otherwise(C.NEUTRAL)
    )


def coarse_polarity(label: Column) -> Column:
    """Looks only at a leading ``positive`` or ``negative``."""
    l = F.lower(label)
    return (
        F.when(F.startswith(l, F.lit("positive")), C.POSITIVE)
        .when(F.startswith(l, F.lit("negative")), C.NEGATIVE)
        .otherwise(C.NEUTRAL)
    )


def label_family(label: Column) -> Column:
    l = F.lower(label)
    chain = F
    for family in ("positive", "negative", "minority", "suggestion"):
        chain = chain.when(F.contains(l, F.lit(family)), family)
    return chain.otherwise("other")
