"""Label, category and run level aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as C
from ..functions import scoring as S
from .reshape import split_categories

LABEL_GROUPS = ("Positive", "Negative", "Minority", "Suggestion", "Self")


def _everything():
    """A window over one row per label; never over table rows."""
    return Window.partitionBy()


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def label_distribution(df: DataFrame, col: str = "prediction", normalize: bool = False) -> DataFrame:
    """Rows (and share) per value, most frequent first; nulls are not counted."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    if normalize:
        counts = counts.withColumn("share", F.col("n") / F.sum("n").over(_everything()))
    return counts.orderBy(F.desc("n"), col)


def label_stats(df: DataFrame, digits: bool = True) -> DataFrame:
    """Per label: count, share in percent, mean confidence, minority rows.
    ``digits=False`` leaves the ratios unrounded."""
    stats = df.groupBy(F.col("prediction").alias("label")).agg(
        F.count("*").alias("count"),
        F.avg("confidence").alias("avg_confidence"),
        count_if(F.col("is_minority_pattern")).alias("minority_count"),
    )
    stats = stats.withColumn("pct", 100.0 * F.col("count") / F.sum("count").over(_everything()))
    stats = stats.filter(F.col("label").isNotNull())
    if digits:
        stats = stats.withColumn("pct", F.round("pct", 2)).withColumn(
            "avg_confidence", F.round("avg_confidence", 4)
        )
    return stats.select("label", "count", "pct", "avg_confidence", "minority_count").orderBy(
        F.desc("count"), "label"
    )


def label_group_totals(stats: DataFrame, groups: Sequence[str] = LABEL_GROUPS) -> DataFrame:
    """Rows per word group; a label counts for every word it contains.  The
    words of a label are an array on its row: no join is needed."""
    words = F.array_compact(F.array(*[
        F.when(F.contains(F.lower("label"), F.lit(g.lower())), F.lit(g)) for g in groups
    ]))
    return (
        stats.select(F.explode(words).alias("label_group"), "count")
        .groupBy("label_group").agg(F.sum("count").alias("total"))
    )


def category_breakdown(df: DataFrame) -> DataFrame:
    """Flagged rows per category, most frequent first.  The joined texts are counted
    first, so only the few distinct ones are split."""
    joined = df.filter(F.col("is_minority_pattern")).groupBy("minority_category").agg(F.count("*").alias("n"))
    return split_categories(joined).groupBy("category").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "category")


def subtype_distribution(df: DataFrame) -> DataFrame:
    return label_distribution(df, "catme_subtype")


def confidence_histogram(df: DataFrame, **bands) -> DataFrame:
    """Rows per confidence band; empty bands do not appear."""
    band = S.confidence_band(F.col("confidence"), **bands)
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


def minority_kpis(df: DataFrame) -> DataFrame:
    flagged = count_if(F.col("is_minority_pattern"))
    return df.agg(
        F.count("*").alias("total"),
        flagged.alias("flagged"),
        (100.0 * flagged / F.greatest(F.lit(1), F.count("*"))).alias("pct"),
        count_if(F.col("is_outlier")).alias("outliers"),
        count_if(F.col("is_minority_cluster")).alias("small_clusters"),
    )


def category_shares(df: DataFrame) -> DataFrame:
    """Each category's rows in percent of all flagged rows."""
    flagged = df.agg(count_if(F.col("is_minority_pattern"))).scalar()
    shares = category_breakdown(df).withColumn("flagged", flagged)
    return shares.withColumn("pct", 100.0 * F.col("n") / F.greatest(F.lit(1), "flagged"))


def minority_job_summary(df: DataFrame) -> DataFrame:
    flagged = count_if(F.col("is_minority_pattern"))
    return df.agg(
        F.count("*").alias("total"),
        flagged.alias("flagged"),
        F.round(100.0 * flagged / F.greatest(F.lit(1), F.count("*")), 2).alias("pct"),
    )


def _real() -> Column:
    return S.is_real_minority(F.col("is_minority_pattern"), F.col("minority_category"))


# Labels whose joint share is watched in course evaluations, and
# the limits of the checks.
COURSE_MAJORITY = ("Majority_Positive", "Teaching_Positive_Clarity", "Teaching_Positive_Engagement")
MAX_MAJORITY_PCT, MIN_NEGATIVES, MIN_REAL_MINORITY, MIN_LABELS = 30, 3000, 500, 8


def success_criteria(df: DataFrame, mode: str) -> DataFrame:
    """One row of checks over the scored table."""
    share = lambda names: 100.0 * F.avg(S.is_one_of(F.col("prediction"), names).cast("int"))
    if mode == C.S2S:
        negatives = count_if(F.startswith(F.col("prediction"), F.lit("Negative_")))
        measured = df.agg(
            share(("Majority_Positive",)).alias("majority_positive_pct"),
            negatives.alias("negative_labeled_count"),
            count_if(_real()).alias("real_minority_count"),
        )
        return measured.select(
            "*",
            (F.col("majority_positive_pct") < MAX_MAJORITY_PCT).alias("pass_majority_pct"),
            (F.col("negative_labeled_count") >= MIN_NEGATIVES).alias("pass_negative_count"),
            (F.col("real_minority_count") >= MIN_REAL_MINORITY).alias("pass_minority_count"),
        )
    measured = df.agg(
        share(COURSE_MAJORITY).alias("majority_positive_pct"),
        F.countDistinct("prediction").alias("n_label_categories"),
        count_if(_real()).alias("real_minority_count"),
    )
    return measured.select(
        "*",
        (F.col("majority_positive_pct") < MAX_MAJORITY_PCT).alias("pass_majority_pct"),
        (F.col("n_label_categories") >= MIN_LABELS).alias("pass_label_spread"),
        (F.col("real_minority_count") > 0).alias("pass_minority_count"),
    )


def run_summary(df: DataFrame, mode: str | None = None, digits: bool = True) -> DataFrame:
    """One row: totals, shares, means, three count maps and, for a ``mode``, its
    checks.

    Totals and maps come from one pass: every row counts once for the whole and
    once for its label, category list and subtype, which the partial aggregate
    folds before the shuffle.  What follows runs on one row per distinct value.
    """
    subtype = F.col("catme_subtype") if "catme_subtype" in df.columns else F.lit(None)
    category = F.when(F.col("is_minority_pattern"), F.col("minority_category"))
    keys = {"all": F.lit(""), "label": F.col("prediction"), "category": category, "subtype": subtype}
    entries = F.array(*[
        F.struct(F.lit(k).alias("kind"), c.cast("string").alias("key")) for k, c in keys.items()
    ])
    mismatch = F.col("mismatch_flag") if "mismatch_flag" in df.columns else F.lit(False)
    cells = df.select(
        F.explode(entries).alias("e"), "is_minority_pattern", "needs_review",
        mismatch.alias("mismatch_flag"), "confidence", "priority_score",
    ).filter(F.col("e.key").isNotNull()).groupBy("e.kind", "e.key").agg(
        F.count("*").alias("rows"),
        count_if(F.col("is_minority_pattern")).alias("minority"),
        count_if(F.col("needs_review")).alias("needs_review"),
        count_if(F.col("mismatch_flag")).alias("mismatch"),
        F.avg("confidence").alias("confidence"), F.avg("priority_score").alias("priority"),
    )
    # A category list counts for each of its categories.
    parts = F.filter(F.transform(F.split("key", r"\|"), lambda c: F.trim(c)), lambda c: c != "")
    names = F.when(F.col("kind") == "category", parts).otherwise(F.array("key"))
    per_key = cells.withColumn("key", F.explode(names))
    totals = per_key.groupBy("kind", "key").agg(F.sum("rows").alias("n"), *[
        F.first(c).alias(c) for c in ("minority", "needs_review", "mismatch", "confidence", "priority")
    ])
    whole = lambda c: F.max(F.when(F.col("kind") == "all", F.col(c)))
    total = F.coalesce(whole("n"), F.lit(0))
    count = lambda c: F.coalesce(whole(c), F.lit(0))
    show = (lambda c, d: F.round(c, d)) if digits else (lambda c, d: c)
    pct = lambda c: show(100.0 * count(c) / F.greatest(F.lit(1), total), 2)
    counted = lambda kind: F.map_from_entries(
        F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n")))
    )
    summary = totals.agg(
        total.alias("total"),
        count("minority").alias("minority"), pct("minority").alias("minority_pct"),
        count("needs_review").alias("needs_review"), pct("needs_review").alias("review_pct"),
        count("mismatch").alias("mismatch"), pct("mismatch").alias("mismatch_pct"),
        show(F.coalesce(whole("confidence"), F.lit(0.0)), 4).alias("avg_confidence"),
        show(F.coalesce(whole("priority"), F.lit(0.0)), 2).alias("avg_priority_score"),
        counted("label").alias("label_distribution"),
        counted("category").alias("minority_category_breakdown"),
        counted("subtype").alias("catme_subtype_distribution"),
    )
    if mode is None:
        return summary
    checks = success_criteria(df, mode).select(F.struct("*"))
    return summary.withColumns({"feedback_mode": F.lit(mode), "success_criteria": checks.scalar()})


def imbalance_check(df: DataFrame, col: str = "label", limit: float = 0.30) -> DataFrame:
    """Labels whose share of the rows exceeds ``limit``."""
    return label_distribution(df, col, normalize=True).filter(F.col("share") > limit)


def prediction_summary(df: DataFrame) -> DataFrame:
    """Rows, mean confidence and label counts of an evaluation run."""
    cells = df.groupBy("prediction").agg(
        F.count("*").alias("n"), F.sum("confidence").alias("s"), F.count("confidence").alias("c")
    )
    return cells.agg(
        F.sum("n").alias("total"),
        (F.sum("s") / F.sum("c")).alias("avg_confidence"),
        F.map_from_entries(
            F.filter(F.collect_list(F.struct("prediction", "n")), lambda e: e["prediction"].isNotNull())
        ).alias("label_distribution"),
    )
