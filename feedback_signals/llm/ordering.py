"""Gapless positions of rows in a sorted order, without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import Stages


def positions(stages: Stages, df: DataFrame, parts: list[str], keys: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: 0, 1, 2 ... within each value of ``parts``, by ``keys``
    ascending, nulls first.

    Rows are dealt by range over parts and keys together, so a part with most of the
    rows is spread like any other; what is counted again is one row per part and
    range.  The result is a table of ``stages``.  Rows that agree in parts and keys
    must be alike, since their order among each other is open.
    """
    order = [F.col(c).asc_nulls_first() for c in (*parts, *keys)]
    dealt = stages.write(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    )
    # the row id counts within a range and carries the number of the range in its upper bits
    ranges = F.shiftright("_row", 33).alias("_range")
    held = dealt.groupBy(*parts, ranges).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*parts).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(
        *[F.col(c).alias(f"_{c}") for c in parts], F.col("_range").alias("_held"),
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_offset"),
    )
    same = F.shiftright("_row", 33) == F.col("_held")
    for c in parts:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    placed = stages.write(dealt.join(offsets, same).select(*df.columns, (F.col("_row") + F.col("_offset")).alias(out)))
    stages.drop(dealt)
    return placed
