"""Deriving truth labels from existing columns, ratings or a scorer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import labels as L
from ..functions.text import strip
from ..session import materialize
from .lookup import attach
from .quantiles import exact_quantiles
from .reshape import named


def rating_profile(df: DataFrame, rating: str):
    """One aggregate row that decides which rating rule applies."""
    r = L.as_number(named(rating))
    return df.select(r.alias("r")).agg(
        F.count("r").alias("n"),
        F.coalesce(F.bool_and(F.col("r").isin(-1.0, 0.0, 1.0)), F.lit(False)).alias("ternary"),
        F.countDistinct(L.rating_to_sentiment(F.col("r"))).alias("classes"),
    ).first()


def labels_from_rating(df: DataFrame, rating: str, training: bool = False) -> DataFrame:
    """``sentiment`` from fixed thresholds, or from the table's own 33 % and
    66 % quantiles when the thresholds give one class at most.  The training
    rule also knows -1/0/1 ratings."""
    profile = rating_profile(df, rating)
    column = named(rating)
    if training and profile.ternary:
        return df.withColumn("sentiment", L.ternary_to_sentiment(column))
    if profile.classes > 1:
        return df.withColumn("sentiment", L.rating_to_sentiment(column))
    return quantile_labels(df, rating)


def quantile_labels(df: DataFrame, rating: str) -> DataFrame:
    numbers = df.select(L.as_number(named(rating)).alias("r"))
    lower, upper = exact_quantiles(numbers, "r", (0.33, 0.66))
    cuts = [F.lit(q).cast("double") for q in (lower, upper)]
    return df.withColumn("sentiment", L.cut_to_sentiment(named(rating), *cuts))


def derive_labels(
    df: DataFrame,
    label_col: str | None = None,
    rating_col: str | None = None,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    training: bool = False,
) -> DataFrame:
    """``sentiment`` from the first source there is: a label column, a rating
    column, a scorer that adds ``sentiment``."""
    if label_col in df.columns:
        return df.withColumn("sentiment", strip(named(label_col).cast("string")))
    if rating_col in df.columns:
        return labels_from_rating(df, rating_col, training)
    if scorer is not None:
        return scorer(df)
    raise ValueError("no label column, no rating column and no scorer to derive labels from")


def first_label_per_text(df: DataFrame, label: str = "label", key: str = "text_hash", row_id: str = "row_id") -> DataFrame:
    """Every row takes the label of the first row with the same text.  An
    aggregate, not a window: a text may fill a third of the table."""
    first = materialize(df.groupBy(key).agg(F.min_by(label, row_id).alias("_first")))
    return attach(df, first, key).withColumn(label, F.col("_first")).drop("_first")


def map_labels(df: DataFrame, mapping: dict[str, str], default: str | None = "Majority_Positive", col: str = "candidate") -> DataFrame:
    """``label`` of each candidate; unknown ones get ``default``, or keep their
    own name when it is ``None``."""
    other = F.col(col) if default is None else F.lit(default)
    return df.withColumn("label", F.coalesce(L.mapped(F.col(col), mapping), other))
