"""Exact positions in a large table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_SLOT = 20_000


def add_position(df: DataFrame, part: str, lead: Column, key: Column, ties: list[str], rows: int, out: str) -> DataFrame:
    """``out``: 0, 1, 2 ... within each value of ``part``, in the order of ``lead``
    (a small whole number), then of ``key`` (a hash), then of ``ties``.

    Rows are cut into slots of the hash that hold about ``ROWS_PER_SLOT`` rows;
    only a slot is sorted in a task, and the slots' counts, a table that many times
    smaller, give the offsets.
    """
    slots = max(1, -(-rows // ROWS_PER_SLOT))
    width = -(-(1 << 32) // slots)
    high = F.shiftrightunsigned(key, 32)  # order of the slot agrees with the order of the key
    cut = df.withColumn("_lead", lead).withColumn("_key", high).withColumn(
        "_slot", (F.col("_key") / width).cast("long")
    )
    before = Window.partitionBy(part).orderBy("_lead", "_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(part, "_lead", "_slot").count()
        .select(part, "_lead", "_slot", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy(part, "_lead", "_slot").orderBy("_key", *ties))
    return (
        cut.withColumn("_row", inside).join(offsets, [part, "_lead", "_slot"])
        .withColumn(out, (F.col("_offset") + F.col("_row") - 1).cast("long"))
        .drop("_lead", "_key", "_slot", "_row", "_offset")
    )
