"""Loaders of the three training sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as C
from ..functions import labels as L
from ..operators.reshape import drop_noise, drop_short, melt_dimensions, named
from ..operators.sampling import stratified_cap
from .files import original_names, read_feedback, read_headerless


def load_peer_comments(spark: SparkSession, path: str) -> DataFrame:
    """Peer comments: one text per line, without noise lines."""
    rows = drop_noise(read_headerless(spark, path).filter(F.col("text").isNotNull()))
    return rows.withColumns({"mode": F.lit(C.S2S), "source": F.lit("peer_comments")})


def course_eval_rows(df: DataFrame, min_chars: int = 3) -> DataFrame:
    """The six fixed (rating, text) pairs as rows.  Absent pairs are skipped; no
    pair at all is an error.  ``row_id`` is renumbered per (row, pair)."""
    stored = {original: name for name, original in original_names(df).items()}
    pairs = [(stored[r], stored[t], d) for r, t, d in C.COURSE_EVAL_PAIRS if r in stored and t in stored]
    if not pairs:
        raise ValueError("none of the course-evaluation column pairs is present")
    long = melt_dimensions(df, pairs, min_chars, keep=("row_id",), min_pairs=1)
    position = F.create_map(*[x for i, p in enumerate(pairs) for x in (F.lit(p[2]), F.lit(i))])
    return long.withColumns({
        "row_id": F.col("row_id") * len(pairs) + position[F.col("dimension")],
        "mode": F.lit(C.S2P),
        "source": F.lit("courseeval"),
    })


def load_course_eval(spark: SparkSession, path: str) -> DataFrame:
    return course_eval_rows(read_feedback(spark, path))


def review_rows(df: DataFrame, n_per_class: int = 50_000, seed: int = 42) -> DataFrame:
    """Rated reviews with a seed label, capped per rating class."""
    wanted = [c for c in ("quality", "difficulty", "comment", "emotional_label", "tags") if c in df.columns]
    rows = df.select("row_id", *[named(c) for c in wanted]).withColumnRenamed("comment", "text")
    rated = rows.withColumn("rating", L.quality_to_rating(F.col("quality"))).filter(F.col("rating").isNotNull())
    kept = drop_short(rated, 10, strip=True)
    if "emotional_label" in wanted:
        seed_label = L.seed_label(F.col("emotional_label"))
    else:
        seed_label = F.lit(None).cast("string")
    labelled = kept.withColumns({
        "pseudo_label": seed_label, "mode": F.lit(C.S2P),
        "source": F.lit("reviews"), "dimension": F.lit("overall"),
    })
    return stratified_cap(labelled, "rating", n_per_class, seed)


def load_reviews(spark: SparkSession, path: str, n_per_class: int = 50_000, seed: int = 42) -> DataFrame:
    return review_rows(read_feedback(spark, path), n_per_class, seed)
