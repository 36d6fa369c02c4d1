"""Joins whose shape is chosen from checked sizes.

* ``attach``: the right side has one row per key.  If a bounded probe shows it
  is small it is broadcast, and the wide left side is not shuffled at all.
  Otherwise a shuffle join runs, with the rows of over-full keys salted, so that
  a key holding a third of the table is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 64 << 20
ROWS_PER_SALT = 1_000_000


def bounded_copy(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """``df`` as a local relation when it has at most ``max_rows`` rows that
    together stay under the byte bound, else ``None``.  At most ``max_rows + 1``
    rows ever reach the driver."""
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows or rows.nbytes > BROADCAST_BYTES:
        return None
    return df.sparkSession.createDataFrame(rows, schema=df.schema)


def attach(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``right`` (unique on the key) to ``left`` for left, inner,
    left_semi or left_anti joins."""
    small = bounded_copy(right, max_rows)
    if small is not None:
        return left.join(F.broadcast(small), on, how)
    return salted_join(left, right, on, how)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    how: str = "left",
    rows_per_salt: int = ROWS_PER_SALT,
    max_heavy: int = BROADCAST_ROWS,
) -> DataFrame:
    """Shuffle join in which each key of more than ``rows_per_salt`` left rows
    is spread over several salts; the matching right row is copied to each.

    The list of such keys has at most ``rows / rows_per_salt`` entries, so it is
    the one thing that is broadcast.  Should it be too long for that, only the
    fuller keys are salted.
    """
    keys = [on] if isinstance(on, str) else list(on)
    counts, over = left.groupBy(*keys).count(), rows_per_salt
    salted = lambda limit: counts.filter(F.col("count") > limit).select(
        *keys, F.ceil(F.col("count") / rows_per_salt).cast("int").alias("_salts")
    )
    while (heavy := bounded_copy(salted(over), max_heavy)) is None:
        over *= 4
    if heavy.isEmpty():
        return left.join(right, keys, how)
    heavy = F.broadcast(heavy)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    # The salt comes from the row itself, so a recomputed task salts it alike.
    hashable = [f.name for f in left.schema if "map<" not in f.dataType.simpleString()]
    spread = left.join(heavy, keys, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*hashable), salts).cast("int")
    ).drop("_salts")
    copies = right.join(heavy, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    ).drop("_salts")
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
