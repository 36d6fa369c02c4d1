"""Training, applying and evaluating the text classifier."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as C
from . import evaluation as E
from .caches import score_distinct
from .labelling import derive_labels
from .lookup import attach
from .reshape import combine_text, drop_short
from .signals import flag_review
from .zero_shot import Scorer, argmax_label


@dataclass(frozen=True)
class TextClassifier:
    """A fitted pipeline, its labels in id order, and how it was chosen."""

    model: PipelineModel
    labels: tuple[str, ...]
    metrics: Mapping[str, float] = field(default_factory=dict)

    def scores(self, df: DataFrame) -> DataFrame:
        drop = ("_words", "_counts", "_features", "rawPrediction", "probability", "_id")
        scored = self.model.transform(df.withColumn("text", F.coalesce("text", F.lit(""))))
        return scored.withColumn("_scores", vector_to_array("probability")).drop(*drop)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        info = {"labels": list(self.labels), "metrics": dict(self.metrics)}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(info),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/metadata")

    @classmethod
    def load(cls, spark, path: str) -> "TextClassifier":
        info = json.loads(spark.read.text(f"{path}/metadata").first().value)
        return cls(PipelineModel.load(f"{path}/model"), tuple(info["labels"]), info["metrics"])


def train_classifier(
    df: DataFrame,
    validation: DataFrame | None = None,
    features: int = 1 << 16,
    reg_params: Sequence[float] = (0.01, 0.1),
    max_iter: int = 30,
    settings: C.Settings = C.DEFAULTS,
) -> TextClassifier:
    """Fit on the rows of ``prepare_training`` (``text, label, label_id,
    is_test``); of the candidate models the one with the best mean F1 over
    boosted labels on the held-out rows is kept."""
    train = df.filter("NOT is_test")
    held_out = df.filter("is_test") if validation is None else validation
    weights = E.class_weights(train, "label", settings.minority_weight, settings.unboosted_labels).cache()
    weighted = attach(train, weights.select("label", "weight"), "label").select("text", "label_id", "weight")
    labels = tuple(
        r.label for r in df.select("label", "label_id").distinct().orderBy("label_id").collect()
    )
    text_stages = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}']+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features", minDocFreq=2),
    ]).fit(weighted)
    prepared = text_stages.transform(weighted).select(
        "_features", F.col("label_id").cast("double").alias("label_id"), "weight"
    ).persist()
    boosted = weights.filter("boosted").select("label")
    best = None
    for reg in reg_params:
        regression = LogisticRegression(
            featuresCol="_features", labelCol="label_id", weightCol="weight", predictionCol="_id",
            family="multinomial", maxIter=max_iter, regParam=reg,
        ).fit(prepared)
        candidate = TextClassifier(PipelineModel([*text_stages.stages, regression]), labels)
        scored = classify(held_out, candidate)
        f1 = E.minority_f1_mean(scored, boosted).first().minority_f1_mean
        macro = E.label_metrics(scored).filter("support > 0").agg(F.avg("f1")).first()[0] or 0.0
        metrics = {"minority_f1_mean": f1, "f1_macro": macro, "reg_param": reg}
        if best is None or (f1, macro) > (best.metrics["minority_f1_mean"], best.metrics["f1_macro"]):
            best = TextClassifier(candidate.model, labels, metrics)
    prepared.unpersist()
    weights.unpersist()
    return best


def classify(
    df: DataFrame,
    model: TextClassifier | None = None,
    scorer: Scorer | None = None,
    labels: Mapping[str, str] | Sequence[str] | None = None,
    threshold: float | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Adds ``prediction``, ``confidence`` and ``needs_review``.  A text that gives the
    scorer no evidence has neither prediction nor confidence and needs review.

    Either a fitted ``model``, or a ``scorer`` over ``labels`` (names, or
    descriptions mapped to names).  ``distinct`` scores each text once, which
    pays for a costly scorer.
    """
    text = F.coalesce("text", F.lit(""))
    if model is not None:
        names: Sequence[str] = model.labels
        score = model.scores
    else:
        names = list(labels.values()) if isinstance(labels, Mapping) else list(labels)
        descriptions = list(labels)
        score = lambda rows: rows.withColumn("_scores", scorer(text, descriptions))
    scored = score_distinct(df, "_scores", score).drop("text_hash") if distinct else score(df)
    predicted = scored.withColumns({
        "prediction": argmax_label(F.col("_scores"), names),
        "confidence": F.array_max("_scores"),
    }).drop("_scores")
    return flag_review(predicted, threshold)


def route_model(df: DataFrame, classifiers: Mapping[str, dict], mode: str | None = None, **kwargs) -> DataFrame:
    """Classify with the model of each feedback mode: one ``mode`` for the whole
    table, or the ``feedback_mode`` of each row.  ``classifiers`` maps a mode to
    the keyword arguments of ``classify``."""
    if mode is not None:
        return classify(df, **classifiers[mode], **kwargs)
    parts = [
        classify(df.filter(F.col("feedback_mode") == m), **how, **kwargs) for m, how in classifiers.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def evaluate(
    df: DataFrame,
    text_cols: Sequence[str],
    label_col: str | None = None,
    rating_col: str | None = None,
    **classifier,
) -> DataFrame:
    """Classified rows with their truth in ``label`` (null when unknown): the
    input of ``classification_report``, ``confusion_matrix`` and
    ``prediction_summary``."""
    rows = drop_short(combine_text(df, text_cols, force=True), 5)
    if label_col in df.columns or rating_col in df.columns:
        rows = derive_labels(rows, label_col, rating_col, training=True)
        rows = rows.withColumn("label", F.col("sentiment")).drop("sentiment")
    else:
        rows = rows.withColumn("label", F.lit(None).cast("string"))
    return classify(rows, **classifier)
