"""Shards that keep linked documents together: balanced label propagation.

Nodes start on a shard by hash.  In each round a join counts, for every node, its
neighbours per shard, and nodes move to the shard that holds most of them.  A
round lets nodes follow their smaller neighbours, the next one their larger
neighbours, so two nodes never swap places.  A shard accepts movers up to its
quota: movers are counted in slots by the neighbour that draws them, so that a
group moves whole, and only the slot at the quota is cut by the movers' own hash.
At the end shards that are over their size give up rows, those without links
first, until counts differ by at most one.

Everything is joins, map-side combined counts and windows over bounded slots; the
driver sees counts per shard and slot only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import Stages
from .ranking import add_position

SLOTS = 512


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), index + 1)


def _accepted(stages: Stages, movers: DataFrame, room: list[int]) -> DataFrame:
    """Movers (node, to, pull) cut so that no shard takes more than its room."""
    movers = movers.withColumn("slot", F.pmod(F.xxhash64("pull"), F.lit(SLOTS))).withColumn(
        "sub", F.pmod(F.xxhash64("node"), F.lit(SLOTS))
    )
    movers = stages.write(movers)

    def fill(counts, left):
        """Slots taken whole in order, and the first that does not fit."""
        last, edge = {}, {}
        for to in left:
            last[to], edge[to] = -1, None
            for slot, n in sorted((r[1], r[2]) for r in counts if r[0] == to):
                if n > left[to]:
                    edge[to] = slot
                    break
                left[to] -= n
                last[to] = slot
        return last, edge

    left = dict(enumerate(room))
    last, edge = fill(movers.groupBy("to", "slot").count().collect(), left)
    edges = [-1 if edge[to] is None else edge[to] for to in left]
    at_edge = F.col("slot") == _pick(edges, F.col("to"))
    sub_last, _ = fill(movers.filter(at_edge).groupBy("to", "sub").count().collect(), left)
    whole = F.col("slot") <= _pick([last[to] for to in left], F.col("to"))
    part = at_edge & (F.col("sub") <= _pick([sub_last[to] for to in left], F.col("to")))
    return movers.filter(whole | part).select("node", "to")


def propagate(nodes: DataFrame, links: DataFrame, shards: int, total: int, rounds: int = 4, slack: float = 0.1) -> DataFrame:
    """``node, shard, linked``: nodes (node) on 0..shards-1, moved along ``links``
    (a, b) under a capacity of ``(1 + slack) * total / shards`` rows."""
    stages = Stages(nodes.sparkSession)
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = stages.write(both)
    start = F.pmod(F.xxhash64("node", F.lit(17)), F.lit(shards)).cast("int")
    linked = both.select(F.col("a").alias("node")).distinct().withColumn("linked", F.lit(True))
    labels = nodes.select("node", start.alias("shard")).join(linked, "node", "left").withColumn(
        "linked", F.coalesce("linked", F.lit(False))
    )
    labels = stages.write(labels)
    capacity = int(total / shards * (1 + slack)) + 1
    for step in range(rounds):
        sizes = {r["shard"]: r["count"] for r in labels.groupBy("shard").count().collect()}
        room = [max(0, capacity - sizes.get(s, 0)) for s in range(shards)]
        toward = both.filter("b < a" if step % 2 == 0 else "b > a")
        where = labels.filter("linked").select("node", "shard")
        votes = (
            toward.join(where.withColumnRenamed("node", "b"), "b")
            .groupBy("a", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("pull"))
        )
        best = votes.groupBy("a").agg(
            F.max(F.struct("n", (-F.col("shard")).alias("order"), "pull")).alias("best"),
            F.map_from_entries(F.collect_list(F.struct("shard", "n"))).alias("by_shard"),  # at most one entry a shard
        )
        movers = (
            best.join(where.withColumnRenamed("node", "a"), "a")
            .filter(F.col("best.n") > F.coalesce(F.col("by_shard")[F.col("shard")], F.lit(0)))
            .select(F.col("a").alias("node"), (-F.col("best.order")).alias("to"), F.col("best.pull").alias("pull"))
        )
        moved = _accepted(stages, movers, room)
        after = labels.join(moved, "node", "left").select(
            "node", F.coalesce("to", "shard").alias("shard"), "linked"
        )
        before, labels = labels, stages.write(after)
        stages.drop(before)
        if moved.isEmpty():
            break
    result = stages.path(keep=True)
    labels.write.parquet(result)
    stages.close()
    return nodes.sparkSession.read.schema(labels.schema).parquet(result)


def level(labels: DataFrame, shards: int, total: int) -> DataFrame:
    """``node, shard`` with counts at most one apart: shards over their size give
    up rows without links first."""
    sizes = {r["shard"]: r["count"] for r in labels.groupBy("shard").count().collect()}
    sizes = [sizes.get(s, 0) for s in range(shards)]
    order = sorted(range(shards), key=lambda s: (-sizes[s], s))
    target = {s: total // shards + (i < total % shards) for i, s in enumerate(order)}
    over = [max(0, sizes[s] - target[s]) for s in range(shards)]
    under = [max(0, target[s] - sizes[s]) for s in range(shards)]
    first = [sum(over[:s]) for s in range(shards)]  # number of the first row that a shard gives up
    ends = [sum(under[: s + 1]) for s in range(shards)]
    placed = add_position(
        labels, "shard", F.col("linked").cast("int"), F.xxhash64("node", F.lit(29)), ["node"], total, "position"
    )
    moves = F.col("position") < _pick(over, F.col("shard"))
    number = F.col("position") + _pick(first, F.col("shard"))
    taker = F.lit(0)
    for end in ends:
        taker = taker + (number >= F.lit(end)).cast("int")
    return placed.select("node", F.when(moves, taker).otherwise(F.col("shard")).cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8, text: str = "text", doc_id: str = "doc_id", rounds: int = 4) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``; equal texts are
    linked to the one with the smallest id.

    A null text counts as empty.  Rows that repeat an id count as rows of their
    own and are told apart by a number.  An empty table gives an empty result;
    further columns are ignored, whatever their names.
    """
    stages = Stages(docs.sparkSession)
    content = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"), F.sha2(content, 256).alias("digest"),
    )
    base = stages.write(base.withColumn("node", F.struct("doc_id", F.row_number().over(_same_row()).alias("copy"))), keep=True)
    total = base.count()
    groups = base.groupBy("digest").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    links = base.select("node", "digest").join(groups, "digest").filter("node <> center").select(
        F.col("node").alias("a"), F.col("center").alias("b")
    )
    labels = propagate(base.select("node"), links, shards, total, rounds)
    final = level(labels, shards, total)
    numbered = add_position(final, "shard", F.lit(0), F.xxhash64("node", F.lit(31)), ["node"], total, "slot")
    return base.join(numbered, "node").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _same_row():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("digest")
