"""Keyed caches of costly per-text results (labels, vectors).

A cache is a Parquet table keyed by the full SHA-256 of the text.  A text may
occur in a large share of the rows, so the costly function only ever sees
distinct texts, and its results are joined back by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import text_hash
from ..session import materialize
from .lookup import attach

KEY = "text_hash"


def with_key(df: DataFrame, text: str = "text") -> DataFrame:
    return df if KEY in df.columns else df.withColumn(KEY, text_hash(F.col(text)))


def distinct_texts(df: DataFrame, row_id: str = "row_id", text: str = "text") -> DataFrame:
    """One row per distinct text: its key, text and first row id.  The partial
    aggregate shrinks copies before the shuffle."""
    keyed = with_key(df, text).filter(F.col(text).isNotNull())
    return keyed.groupBy(KEY).agg(
        F.min(row_id).alias(row_id), F.any_value(text).alias(text)
    )


def first_written(cache: DataFrame, value: str) -> DataFrame:
    """One row per key: the pair of the earliest batch, and of one batch the least
    value.  A key that two writers recorded multiplies no row, and all readers agree."""
    batch = F.coalesce("batch", F.lit(0)) if "batch" in cache.columns else F.lit(0)
    return cache.groupBy(KEY).agg(F.min(F.struct(batch.alias("batch"), F.col(value)))[value].alias(value))


def apply_cache(df: DataFrame, cache: DataFrame, value: str, text: str = "text") -> DataFrame:
    """Every row with its cached ``value`` (null when unknown)."""
    return attach(with_key(df, text), first_written(cache, value), KEY, "left")


def not_cached(df: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text is not in the cache."""
    return attach(with_key(df, text), cache.select(KEY).distinct(), KEY, "left_anti")


def append_cache(cache_path: str, fresh: DataFrame, value: str) -> None:
    """Add pairs whose key is new, as the next batch.  Writers that run at once may
    both record a key; ``first_written`` decides between them."""
    spark = fresh.sparkSession
    pairs, batch = fresh.groupBy(KEY).agg(F.min(value).alias(value)), 1
    if table_exists(spark, cache_path):
        held = read_cache(spark, cache_path, fresh.select(KEY, value))
        batch = 1 + (held.agg(F.max("batch")).first()[0] or 0)
        pairs = pairs.join(held.select(KEY), KEY, "left_anti")
    pairs.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(cache_path)


def read_cache(spark, cache_path: str, pairs: DataFrame) -> DataFrame:
    """The table of pairs as written, with ``batch`` (null in tables without it)."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(cache_path)


def compact_cache(cache_path: str, target: str, value: str, spark) -> None:
    """The same pairs with one row per key, written to a new folder; readers of the old
    one are not disturbed."""
    cache = spark.read.option("mergeSchema", True).parquet(cache_path)
    first_written(cache, value).withColumn("batch", F.lit(1).cast("long")).write.parquet(target)


def table_exists(spark, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def score_distinct(
    df: DataFrame,
    value: str,
    score: Callable[[DataFrame], DataFrame],
    cache_path: str | None = None,
    text: str = "text",
    row_id: str = "row_id",
) -> DataFrame:
    """Rows of ``df`` plus ``value``, computing ``score`` only for distinct
    texts that no earlier run recorded.

    ``score`` takes ``(text_hash, row_id, text)`` rows and adds ``value``.  With
    a cache the new pairs are written first and then read back, so the costly
    function runs once even if a later task is retried.
    """
    keyed = with_key(df, text)
    texts = distinct_texts(keyed, row_id, text)
    if cache_path is None:
        # Stored, so that choosing the join does not run the function again.
        return attach(keyed, materialize(score(texts).select(KEY, value)), KEY)
    spark = df.sparkSession
    if table_exists(spark, cache_path):
        texts = not_cached(texts, spark.read.parquet(cache_path), text)
    fresh = score(texts).select(KEY, value).filter(F.col(value).isNotNull())
    append_cache(cache_path, fresh, value)
    return apply_cache(keyed, read_cache(spark, cache_path, fresh), value, text)
