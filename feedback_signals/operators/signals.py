"""Row flags: lexicon hits, detector merge, review, priority, mismatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import config as C
from ..functions import scoring as S
from ..functions.lexicon import Lexicon, matched_categories


def match_lexicon(df: DataFrame, lexicon: Lexicon, none_label: str = "", text: str = "text") -> DataFrame:
    """Adds ``keyword_minority`` and the ``|``-joined ``keyword_categories``;
    rows without a hit get ``none_label``."""
    lowered = df.withColumn("_lower", F.lower(F.col(text)))
    found = lowered.withColumn("_cats", matched_categories(F.col("_lower"), lexicon))
    hit = F.size("_cats") > 0
    return found.withColumns({
        "keyword_minority": hit,
        "keyword_categories": F.when(hit, F.array_join("_cats", "|")).otherwise(none_label),
    }).drop("_cats", "_lower")


def categorize_flagged(
    df: DataFrame, lexicon: Lexicon | None, flag: str = "is_minority_pattern", scorer=None, text: str = "text"
) -> DataFrame:
    """``minority_category`` of flagged rows: their lexicon categories, else
    what ``scorer`` says (a function from rows to rows with ``categories``),
    else the outlier-only mark.  Unflagged rows get an empty text.

    Without a ``lexicon`` the keyword columns that ``match_lexicon`` left are
    used, which saves the second search.
    """
    if lexicon is None:
        found, worded = df, F.when(F.col("keyword_minority"), F.col("keyword_categories"))
    else:
        # Rows that are not flagged have nothing to search.
        lowered = df.withColumn("_lower", F.when(F.col(flag), F.lower(F.col(text))))
        found = lowered.withColumn("_cats", matched_categories(F.col("_lower"), lexicon)).drop("_lower")
        worded = F.when(F.size("_cats") > 0, F.array_join("_cats", "|"))
    by_words = F.when(~F.col(flag), F.lit("")).otherwise(worded)
    if scorer is None:
        return found.withColumn(
            "minority_category", F.coalesce(by_words, F.lit(C.OUTLIER_ONLY))
        ).drop("_cats")
    worded = found.withColumn("minority_category", by_words).drop("_cats")
    open_rows = worded.filter(F.col("minority_category").isNull())
    done = worded.filter(F.col("minority_category").isNotNull())
    scored = scorer(open_rows).withColumn("minority_category", F.col("categories"))
    return done.unionByName(scored.select(done.columns))


def merge_minority_flags(df: DataFrame, embedding: bool = True) -> DataFrame:
    """Keyword or detector; keyword categories win.  Without a detector its
    columns are filled in as negative."""
    if not embedding:
        return df.withColumns({
            "is_outlier": F.lit(False), "is_minority_cluster": F.lit(False),
            "is_noise": F.lit(False), "cluster_id": F.lit(-1).cast("long"),
            "is_minority_pattern": F.col("keyword_minority"),
            "minority_category": F.col("keyword_categories"),
        })
    category = F.when(F.col("keyword_minority"), F.col("keyword_categories")).otherwise(
        F.coalesce("minority_category", F.lit(""))
    )
    return df.withColumns({
        "is_minority_pattern": F.col("is_minority_pattern") | F.col("keyword_minority"),
        "minority_category": category,
    })


def suppress_positive_outliers(df: DataFrame, tiers: C.Tiers = C.DEFAULTS.tiers) -> DataFrame:
    """An outlier without keyword evidence and with a generic positive label is
    not a minority signal."""
    drop = (
        ~F.col("keyword_minority")
        & F.contains(F.coalesce("minority_category", F.lit("")), F.lit(C.OUTLIER_ONLY))
        & S.is_one_of(F.col("prediction"), tiers.deprioritized)
    )
    return df.withColumns({
        "is_minority_pattern": F.col("is_minority_pattern") & ~drop,
        "minority_category": F.when(drop, "").otherwise(F.col("minority_category")),
    })


def flag_review(df: DataFrame, threshold: float | None = None) -> DataFrame:
    """``needs_review`` from the raw confidence, which is then rounded.  A row without
    confidence needs review."""
    limit = C.DEFAULTS.review_threshold if threshold is None else threshold
    return df.withColumns({
        "needs_review": F.coalesce(F.col("confidence") < limit, F.lit(True)),
        "confidence": F.round("confidence", 4),
    })


def real_minority(df: DataFrame, require_nonempty: bool = False) -> DataFrame:
    return df.filter(
        S.is_real_minority(F.col("is_minority_pattern"), F.col("minority_category"), require_nonempty)
    )


def add_priority(df: DataFrame, settings: C.Settings = C.DEFAULTS) -> DataFrame:
    real = S.is_real_minority(F.col("is_minority_pattern"), F.col("minority_category"))
    return df.withColumn("priority_score", S.priority_score(
        F.col("prediction"), real, F.col("confidence"), settings.tiers, settings.boost_below
    ))


def detect_mismatch(
    df: DataFrame,
    rating: str | None = "rating",
    prediction: str = "prediction",
    high: float = C.DEFAULTS.high_rating,
    low: float = C.DEFAULTS.low_rating,
    polarity: str = "broad",
) -> DataFrame:
    """Adds ``mismatch_flag`` and ``mismatch_type``; a table without the columns
    has no mismatches."""
    if rating not in df.columns or prediction not in df.columns:
        return df.withColumns({"mismatch_flag": F.lit(False), "mismatch_type": F.lit("")})
    kind = S.mismatch_type(F.col(prediction), F.col(rating), high, low, polarity)
    return df.withColumn("mismatch_type", kind).withColumn("mismatch_flag", F.col("mismatch_type") != "")
