"""Preparing labelled training sets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..functions import labels as L
from ..functions.text import feedback_subtype, longer_than, strip
from ..operators import evaluation as E
from ..operators.aggregates import imbalance_check, label_distribution
from ..operators.lookup import attach
from ..operators.reshape import anonymize
from ..operators.sampling import encode_labels, random_split, stratified_split, undersample
from ..operators.zero_shot import Scorer, label_by_dimension, zero_shot_label


@dataclass(frozen=True)
class TrainingSet:
    rows: DataFrame                # row_id, text, label, label_id, is_test
    validation: DataFrame | None   # the same columns, when given from outside
    distribution: DataFrame        # before undersampling
    encoding: DataFrame            # label, label_id
    weights: DataFrame             # label, n, boosted, weight of the training side


def clean_labelled(df: DataFrame, label: str = "sentiment") -> DataFrame:
    """Usable ``(row_id, text, label)`` rows."""
    rows = df.filter(longer_than(F.col("text"), 10) & F.col(label).isNotNull())
    trimmed = rows.select(
        "row_id", strip(F.col("text")).alias("text"), strip(F.col(label).cast("string")).alias("label")
    )
    return trimmed.filter(F.col("label") != "nan")


def align_by_row(df: DataFrame, subset: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``row_id`` occurs in ``subset``."""
    return df.join(subset.select("row_id"), "row_id", "left_semi")


def prepare_training(
    df: DataFrame,
    label: str = "sentiment",
    validation: DataFrame | None = None,
    settings: C.Settings = C.DEFAULTS,
) -> TrainingSet:
    """Clean, undersample, encode, split and weight."""
    clean = clean_labelled(df, label)
    rows = undersample(clean, "label", settings.undersample_ratio, settings.seed)
    encoding = encode_labels(rows)
    if encoding.limit(2).count() < 2:
        raise ValueError("training needs at least two classes")
    split = stratified_split(attach(rows, encoding, "label", "inner"), "label", settings.test_share, settings.seed)
    outside = None
    if validation is not None:
        kept = validation.filter(F.col("text").isNotNull() & F.col(label).isNotNull()).select(
            "row_id", strip(F.col("text")).alias("text"), strip(F.col(label).cast("string")).alias("label")
        )
        known = E.keep_known_labels(kept, encoding)
        if not known.isEmpty():
            outside = attach(known, encoding, "label", "inner")
    weights = E.class_weights(split.filter("NOT is_test"), "label", settings.minority_weight, settings.unboosted_labels)
    return TrainingSet(split, outside, label_distribution(clean, "label", normalize=True), encoding, weights)


def prepare_peer_training(
    comments: DataFrame,
    scorer: Scorer | None = None,
    cache_folder: str | None = None,
    ner=None,
    settings: C.Settings = C.DEFAULTS,
) -> tuple[DataFrame, DataFrame]:
    """Peer comments with subtype and label, and the over-represented labels."""
    typed = comments.withColumn("subtype", feedback_subtype(F.col("text")))
    masked = anonymize(typed, placeholder=settings.placeholder, ner=ner)
    parts = []
    for subtype in (C.PEER, C.SELF):
        cache = None if cache_folder is None else f"{cache_folder}/{subtype}"
        part = masked.filter(F.col("subtype") == subtype)
        parts.append(zero_shot_label(part, C.CANDIDATE_LABELS[subtype], scorer, cache))
    labelled = parts[0].unionByName(parts[1])
    return labelled, imbalance_check(labelled, "sentiment")


def combine_training(
    reviews: DataFrame,
    course_eval: DataFrame,
    scorer: Scorer | None = None,
    include_course_eval: bool = True,
    settings: C.Settings = C.DEFAULTS,
) -> tuple[DataFrame, DataFrame]:
    """(train, validation): reviews plus the labelled training side of the
    course evaluation, and its held-out side."""
    split = random_split(course_eval, settings.test_share, settings.seed)
    held_out = split.filter("is_test").drop("is_test")
    if not include_course_eval:
        return reviews, held_out
    # Labelled on all rows, because the first row of a text decides its label.
    labelled = label_by_dimension(course_eval, scorer)
    train_side = random_split(labelled, settings.test_share, settings.seed).filter("NOT is_test")
    marked = train_side.drop("is_test").withColumn("source", F.lit("courseeval_labeled"))
    return reviews.unionByName(marked, allowMissingColumns=True), held_out


def label_held_out(course_eval: DataFrame, scorer: Scorer | None = None, settings: C.Settings = C.DEFAULTS,
                   by_rating: bool = False) -> DataFrame:
    """The held-out course rows with their label: by dimension, or by the sign
    of the rating when no scorer may be used."""
    if by_rating:
        split = random_split(course_eval, settings.test_share, settings.seed)
        return split.filter("is_test").drop("is_test").withColumn(
            "sentiment", L.ternary_to_sentiment(F.col("rating"))
        )
    labelled = label_by_dimension(course_eval, scorer)
    split = random_split(labelled, settings.test_share, settings.seed)
    return split.filter("is_test").drop("is_test")


def prepare_course_training(
    reviews: DataFrame,
    course_eval: DataFrame,
    scorer: Scorer | None = None,
    cache_path: str | None = None,
    keep_dimension_labels: bool = True,
    settings: C.Settings = C.DEFAULTS,
) -> tuple[DataFrame, DataFrame]:
    """(train, validation) for the course model, both with ``sentiment``; a review
    without evidence for any label has none, and ``prepare_training`` leaves it out.

    ``keep_dimension_labels=False`` relabels the course-evaluation rows among
    all 24 descriptions as well.
    """
    train, _ = combine_training(reviews, course_eval, scorer, settings=settings)
    if keep_dimension_labels:
        done = train.filter(F.col("sentiment").isNotNull())
        todo = train.filter(F.col("sentiment").isNull()).drop("sentiment")
        labelled = zero_shot_label(todo, C.PROFESSOR_CANDIDATES, scorer, cache_path)
        train = done.unionByName(labelled, allowMissingColumns=True)
    else:
        train = zero_shot_label(train.drop("sentiment"), C.PROFESSOR_CANDIDATES, scorer, cache_path)
    return train, label_held_out(course_eval, scorer, settings)
