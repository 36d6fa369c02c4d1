"""Connected components by alternating large and small stars.

Every round is two joins and map-side combined minima over the links; the number
of rounds grows with the logarithm of the longest chain.  Rounds are written to
the shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import Stages


def _state(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.filter("u <> v")
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.explode(F.array(
        F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
    )).alias("e")).select("e.u", "e.v")
    return small.filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of an edge that is not the least of its
    component; ``root`` is the least.  Loops and repeated edges are harmless."""
    stages = Stages(edges.sparkSession)
    current = stages.write(
        edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    state = _state(current)
    while state[0]:
        following = stages.write(_round(current))
        stages.drop(current)
        current, before, state = following, state, _state(following)
        if state == before:
            break
    kept = stages.write(current, keep=True)
    stages.close()
    return kept.select(F.col("u").alias("node"), F.col("v").alias("root"))
