"""Class weights and classification metrics from a confusion table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config as C


def _everything():
    """A window over one row per label; never over table rows."""
    return Window.partitionBy()



def class_weights(
    df: DataFrame,
    label: str = "label",
    mult: float = C.DEFAULTS.minority_weight,
    exempt: Sequence[str] = C.DEFAULTS.unboosted_labels,
) -> DataFrame:
    """Balanced weight per label, times ``mult`` for labels rarer than the most
    frequent one unless exempt.  ``boosted`` marks the latter."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    boosted = (F.col("n") < F.max("n").over(_everything())) & ~F.col(label).isin(*exempt)
    balanced = F.sum("n").over(_everything()) / (F.count("*").over(_everything()) * F.col("n"))
    sized = counts.withColumns({"boosted": boosted, "balanced": balanced})
    return sized.select(
        label, "n", "boosted",
        F.when(F.col("boosted"), F.col("balanced") * mult).otherwise(F.col("balanced")).alias("weight"),
    )


def confusion_matrix(df: DataFrame, truth: str = "label", pred: str = "prediction") -> DataFrame:
    """Rows per (true, predicted) pair.  Rows without truth are left out."""
    return (
        df.filter(F.col(truth).isNotNull())
        .groupBy(F.col(truth).alias("truth"), F.col(pred).alias("predicted"))
        .agg(F.count("*").alias("n"))
    )


def confusion_table(df: DataFrame, truth: str = "label", pred: str = "prediction") -> DataFrame:
    """The same as a wide table, one column per predicted label."""
    return confusion_matrix(df, truth, pred).groupBy("truth").pivot("predicted").agg(F.sum("n")).na.fill(0)


def _sides(confusion: DataFrame) -> DataFrame:
    """Each confusion cell seen from its true and from its predicted label."""
    same = F.col("truth") == F.col("predicted")
    zero, n = F.lit(0).cast("long"), F.col("n")
    side = lambda name, support, predicted, hits: F.struct(
        name.alias("label"), support.alias("support"), predicted.alias("predicted"), hits.alias("hits")
    )
    return confusion.select(F.explode(F.array(
        side(F.col("truth"), n, zero, F.when(same, n).otherwise(zero)),
        side(F.col("predicted"), zero, n, zero),
    )).alias("s")).select("s.*")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def label_metrics(df: DataFrame, truth: str = "label", pred: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of every true or predicted label."""
    sums = (
        _sides(confusion_matrix(df, truth, pred)).filter(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))
    )
    return sums.select(
        "label",
        _ratio(F.col("hits"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2.0 * F.col("hits"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
    )


def classification_report(df: DataFrame, truth: str = "label", pred: str = "prediction") -> DataFrame:
    """``label_metrics`` and two average rows."""
    metrics = label_metrics(df, truth, pred)
    names = ("precision", "recall", "f1")
    macro = metrics.agg(*[F.avg(m).alias(m) for m in names], F.sum("support").alias("support"))
    weighted = metrics.agg(
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in names],
        F.sum("support").alias("support"),
    )
    return (
        metrics
        .unionByName(macro.withColumn("label", F.lit("macro avg")))
        .unionByName(weighted.withColumn("label", F.lit("weighted avg")))
    )


def minority_f1_mean(
    df: DataFrame, minority_labels: DataFrame, truth: str = "label", pred: str = "prediction"
) -> DataFrame:
    """Mean F1 of those ``minority_labels`` (one ``label`` column) that occur in
    the truth; 0 when none does."""
    seen = label_metrics(df, truth, pred).filter("support > 0")
    kept = seen.join(minority_labels.select(F.col("label")), "label", "left_semi")
    return kept.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("minority_f1_mean"))


def label_universe(df: DataFrame, truth: str = "label", pred: str = "prediction") -> DataFrame:
    """Sorted distinct labels that are true or predicted somewhere.  Aggregated
    to pairs first, so the union sees only the vocabulary."""
    pairs = df.select(F.col(truth).alias("t"), F.col(pred).alias("p")).distinct()
    both = pairs.select(F.explode(F.array("t", "p")).alias("label"))
    return both.filter(F.col("label").isNotNull()).distinct().orderBy("label")


def keep_known_labels(df: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    from .lookup import attach

    names = train.filter(F.col(label).isNotNull()).select(label).distinct()
    return attach(df, names, label, "left_semi")
