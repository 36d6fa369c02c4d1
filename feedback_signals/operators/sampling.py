"""Exact-size random choices that are reproducible on any partitioning.

The random order of rows is ``md5(seed:row_id)``.  "The first n rows of each
class in hash order" does not need a class sorted in one task: the leading hex
digits of the hash cut every class into 65,536 even slices, one aggregate over
the narrow key columns finds the slice that holds the n-th row, only that slice
is ranked, and the rank gives a cut-off.  The wide rows are then filtered by
comparing with the cut-off of their class, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import hash_order
from .lookup import attach

_SLICE_DIGITS = 4
_TOP_K = 50_000


def _mark_quota(df: DataFrame, by: str, quota: Column, seed: int, row_id: str) -> DataFrame:
    """``df`` plus ``_taken``: is the row among the first ``quota`` rows of its
    class?  ``quota`` may use ``_size``, the number of rows of the class."""
    narrow = df.select(by, row_id).withColumn("_hash", hash_order(F.col(row_id), seed))
    narrow = narrow.withColumn("_slice", F.substring("_hash", 1, _SLICE_DIGITS))
    slices = narrow.groupBy(by, "_slice").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(by).orderBy("_slice")
    cuts = (
        slices.withColumn("_upto", F.sum("_n").over(running))
        .withColumn("_size", F.sum("_n").over(Window.partitionBy(by)))
        .withColumn("_quota", quota.cast("long"))
        .filter(F.col("_upto") >= F.least("_quota", "_size"))
        .groupBy(by)
        .agg(F.min(F.struct("_slice", "_upto", "_n", "_quota", "_size")).alias("c"))
        .select(
            by,
            F.col("c._slice").alias("_cut"),
            (F.col("c._quota") - F.col("c._upto") + F.col("c._n")).alias("_left"),
            (F.col("c._quota") >= F.col("c._size")).alias("_whole"),
        )
    )
    partial = cuts.filter("NOT _whole").drop("_whole")
    edge = attach(narrow, partial, by, "inner").filter("_slice = _cut")
    in_slice = Window.partitionBy(by).orderBy("_hash", row_id)
    last = (
        edge.withColumn("_rank", F.row_number().over(in_slice))
        .filter("_rank = _left")
        .select(by, F.col("_hash").alias("_last_hash"), F.col(row_id).alias("_last_id"))
    )
    limits = cuts.select(by, "_whole").join(last, by, "left")
    h = hash_order(F.col(row_id), seed)
    taken = (
        F.col("_whole")
        | (h < F.col("_last_hash"))
        | ((h == F.col("_last_hash")) & (F.col(row_id) <= F.col("_last_id")))
    )
    return (
        attach(df, limits, by, "inner")
        .withColumn("_taken", F.coalesce(taken, F.lit(False)))
        .drop("_whole", "_last_hash", "_last_id")
    )


def stratified_cap(df: DataFrame, by: str, n: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """At most ``n`` rows per class, without replacement; null classes drop out."""
    return _mark_quota(df, by, F.lit(n), seed, row_id).filter("_taken").drop("_taken")


def undersample(
    df: DataFrame, label: str = "label", ratio: float = 3, seed: int = 42, row_id: str = "row_id"
) -> DataFrame:
    """Classes above ``ratio`` times the second largest class are cut to that
    size; with fewer than two classes nothing is cut."""
    known = df.filter(F.col(label).isNotNull())
    sizes = known.groupBy(label).count()
    top = [r["count"] for r in sizes.orderBy(F.desc("count")).limit(2).collect()]
    if len(top) < 2 or top[0] <= int(top[1] * ratio):
        return known
    return stratified_cap(known, label, int(top[1] * ratio), seed, row_id)


def stratified_split(
    df: DataFrame, label: str = "label", test: float = 0.2, seed: int = 42, row_id: str = "row_id"
) -> DataFrame:
    """``df`` plus boolean ``is_test``; each class gives ``round(test * size)``
    rows to the test side."""
    quota = F.floor(F.col("_size") * test + 0.5)
    return _mark_quota(df, label, quota, seed, row_id).withColumnRenamed("_taken", "is_test")


def hash_share(row_id: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from the row's hash."""
    digits = F.substring(hash_order(row_id, seed), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 32))


def random_split(df: DataFrame, test: float = 0.2, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """``df`` plus ``is_test``, decided row by row from the hash: no shuffle."""
    return df.withColumn("is_test", hash_share(F.col(row_id), seed) < test)


def sample_n(df: DataFrame, n: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows, or all when there are fewer.  A small sample is a
    top-k; a large one is cut by hash so that no task has to hold it."""
    if n <= _TOP_K:
        return df.orderBy(hash_order(F.col(row_id), seed), row_id).limit(n)
    one_class = df.withColumn("_class", F.lit(1))
    return stratified_cap(one_class, "_class", n, seed, row_id).drop("_class")


def encode_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Sorted distinct labels with dense ids from 0."""
    names = df.filter(F.col(label).isNotNull()).select(label).distinct()
    # One row per label: the window runs over the vocabulary, not the table.
    ids = F.row_number().over(Window.orderBy(label)) - 1
    return names.select(F.col(label), ids.alias("label_id"))


def attach_label_ids(df: DataFrame, label: str = "label") -> DataFrame:
    return attach(df, encode_labels(df, label), label, "inner")
