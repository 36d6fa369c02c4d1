"""The whole chain from a feedback table to the scored table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as C
from ..functions import labels as L
from ..functions import scoring as S
from ..functions.lexicon import Lexicon
from ..functions.text import feedback_subtype, phrases_present
from ..operators import signals as G
from ..operators.aggregates import minority_job_summary
from ..operators.caches import with_key
from ..operators.classifier import classify, route_model
from ..operators.detect import detect_minority
from ..operators.embeddings import Embedder
from ..operators.entities import mixed_signals
from ..operators.reshape import anonymize, drop_short, feedback_mode_of, melt_dimensions
from ..operators.views import by_priority
from ..operators.zero_shot import token_cosine, zero_shot_multi
from ..session import materialize, spread_small
from ..sources.files import Ingested, detect_roles, read_feedback

# Without a trained model a text is compared with the label descriptions.
DESCRIPTION_CLASSIFIERS: Mapping[str, dict] = {
    C.S2S: {"scorer": token_cosine, "labels": {**C.PEER_CANDIDATES, **C.SELF_CANDIDATES}},
    C.S2P: {"scorer": token_cosine, "labels": C.PROFESSOR_CANDIDATES},
}


@dataclass(frozen=True)
class Options:
    """What varies from run to run."""

    lexicon: Lexicon
    classifiers: Mapping[str, dict] = None
    settings: C.Settings = C.DEFAULTS
    anonymize: bool = True
    ner: object = None
    include_minority: bool = True
    include_mismatch: bool = True
    score_unmatched: bool = False
    polarity: str = "broad"
    embedder: Embedder | None = None
    embedding_cache: str | None = None
    cap: int | None = None


def score_rows(
    df: DataFrame,
    mode: str,
    options: Options,
    rating_col: str | None = None,
    subtype_phrases=C.FIRST_PERSON_PHRASES,
) -> DataFrame:
    """Subtype, classification and lexicon columns: the row-wise stages."""
    rows = df.withColumn("feedback_mode", F.lit(mode))
    if mode == C.S2S:
        rows = rows.withColumn("catme_subtype", feedback_subtype(F.col("text"), subtype_phrases))
    classifiers = options.classifiers or DESCRIPTION_CLASSIFIERS
    rows = route_model(rows, classifiers, mode, threshold=options.settings.review_threshold)
    return G.match_lexicon(rows, options.lexicon)


def finish_rows(df: DataFrame, options: Options, rating_col: str | None, entity: str | None = None) -> DataFrame:
    """Suppression, mixed signals, priority and mismatch, in this order: a row
    flagged for mixed signals counts as a real minority row."""
    settings = options.settings
    rows = df
    if settings.suppress_positive_outliers:
        rows = G.suppress_positive_outliers(rows, settings.tiers)
    if settings.mixed_signal_detection:
        rows = mixed_signals(rows, entity, settings.tiers)
    rows = G.add_priority(rows, settings)
    if options.include_mismatch and rating_col is not None:
        rows = G.detect_mismatch(
            rows, rating_col, high=settings.high_rating, low=settings.low_rating, polarity=options.polarity
        )
    return rows


def run_pipeline(
    source: DataFrame | Ingested,
    options: Options,
    mode: str | None = None,
    entity: str | None = None,
) -> DataFrame:
    """The scored table of ``source`` (with ``row_id``), unordered; see
    ``by_priority`` for reading it in order."""
    found = source if isinstance(source, Ingested) else detect_roles(spread_small(source))
    settings, rating_col = options.settings, found.rating_col
    rows = drop_short(found.df, settings.min_chars)
    if mode is None:
        mode = feedback_mode_of(rows)
    if mode == C.S2P and found.pairs:
        used = {c for pair in found.pairs for c in pair[:2]}
        keep = [c for c in rows.columns if c not in used and c not in ("text", "rating", "dimension")]
        position = F.create_map(*[x for i, p in enumerate(found.pairs) for x in (F.lit(p[2]), F.lit(i))])
        rows = melt_dimensions(rows, found.pairs, keep=keep)
        rows = rows.withColumn("row_id", F.col("row_id") * len(found.pairs) + position[F.col("dimension")])
        rating_col = "rating"
    if options.anonymize:
        # After the melt, so that no name survives in the source columns.
        rows = anonymize(rows, placeholder=settings.placeholder, ner=options.ner)
    rows = score_rows(rows, mode, options, rating_col)
    if options.include_minority:
        # Read the texts once: the detector's passes, and the result, start from
        # this table and take only the columns they need.
        rows = materialize(with_key(rows))
        rows = detect_minority(
            rows, None, options.embedder, options.embedding_cache, settings,
            scorer=zero_shot_multi if options.score_unmatched else None, cap=options.cap,
        )
    rows = G.merge_minority_flags(rows, embedding=options.include_minority)
    return finish_rows(rows, options, rating_col, entity)


def run_file(spark: SparkSession, path: str, options: Options, mode: str | None = None) -> DataFrame:
    return by_priority(run_pipeline(read_feedback(spark, path), options, mode))


def run_minority(df: DataFrame | Ingested, options: Options) -> tuple[DataFrame, DataFrame]:
    """Detection only: the flagged rows, and a one-row summary."""
    found = df if isinstance(df, Ingested) else detect_roles(spread_small(df))
    rows = drop_short(found.df, options.settings.min_chars)
    if options.anonymize:
        rows = anonymize(rows, placeholder=options.settings.placeholder, ner=options.ner)
    # Here a text without a hit carries the outlier mark as its category.
    rows = materialize(with_key(G.match_lexicon(rows, options.lexicon, none_label=C.OUTLIER_ONLY)))
    rows = detect_minority(
        rows, None, options.embedder, options.embedding_cache, options.settings,
        scorer=zero_shot_multi if options.score_unmatched else None, cap=options.cap,
    )
    merged = G.merge_minority_flags(rows)
    flagged = merged.filter("is_minority_pattern").select(
        "row_id", F.col("text").alias("feedback"), "is_outlier", "is_minority_cluster",
        "minority_category", "cluster_id",
    )
    return flagged, minority_job_summary(merged)


def score_texts(df: DataFrame, classifiers: Mapping[str, dict] | None = None, mode: str | None = None,
                settings: C.Settings = C.DEFAULTS) -> DataFrame:
    """Ad-hoc texts: prediction, broad sentiment, and priority with no minority
    evidence.  Without ``mode`` every text decides its own."""
    classifiers = classifiers or DESCRIPTION_CLASSIFIERS
    if mode is None:
        text = F.coalesce("text", F.lit(""))
        peer = phrases_present(text, C.PEER_SIGNALS) >= phrases_present(text, C.PROFESSOR_SIGNALS)
        moded = df.withColumn("feedback_mode", F.when(peer, C.S2S).otherwise(C.S2P))
        scored = route_model(moded, classifiers, threshold=settings.review_threshold)
    else:
        scored = classify(df.withColumn("feedback_mode", F.lit(mode)), **classifiers[mode], threshold=settings.review_threshold)
    return scored.withColumns({
        "broad_sentiment": L.broad_sentiment(F.col("prediction")),
        "priority_score": S.priority_score(
            F.col("prediction"), F.lit(False), F.col("confidence"), settings.tiers, settings.boost_below
        ),
    })
