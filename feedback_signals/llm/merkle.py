"""Merkle manifest of a dataset, climbed by a recursive query.

A row's leaf is the SHA-256 of its fields, each with its length.  The leaves of one
source, by ascending ``doc_id``, are the lowest level of its tree; every ``ARITY``
consecutive nodes become one node of the next level (the last run may be shorter)
until one is left, the subroot.  Subroots, ordered by source, are the lowest level
of the tree above, which ends in the root.

The manifest is a table of nodes, one row per node with the id of its parent and its
siblings, the hashes of the rest of its run left and right of it.  A node on every
``STRIDE``-th level also carries those of the nodes above it, up to the next such level
or the top of its tree (``up``, ``path``).  ``climb`` starts one row per leaf, with any
hash in its place, and a recursive query joins it with the node it stands at: each
step appends the path's siblings, folds the hash with them and moves up.

A node's id is the position of its first leaf in the whole order and its level, so
ids need no lookup.  Levels are built in blocks of ``ARITY ** BLOCK`` nodes: the
nodes of a block meet in one group of bounded size that builds ``BLOCK`` levels, so a
source with most of the rows is many groups, and jobs number a sixth of the levels.

Rows: a null field is ``-`` in the leaf; null sources form one tree, the first; null
ids come first; rows of one source and id are ordered by their leaves, and rows that
are alike in all fields are leaves of their own.  A sole leaf is its own subroot, and
a sole subroot the root.  An empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..session import Stages
from .ordering import positions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Levels that are built in one group, and that a climb passes in one step.
BLOCK = 6
STRIDE = BLOCK
#: Ids leave so much room for the level, the upper half for the tree over the sources.
_LEVELS, _ABOVE = 128, 64


class Manifest(NamedTuple):
    """``lowest`` and ``upper``: the nodes of level 0 and of the others, as node, parent, level, jump (on every ``STRIDE``-th level), up, path.
    ``trees``: tree, subroot.  ``root``: hex, null without rows.
    ``leaves``: place, node, tree, the columns given, leaf."""

    lowest: DataFrame
    upper: DataFrame
    trees: DataFrame
    root: str | None
    leaves: DataFrame


def leaf(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields, each as its length in bytes, a colon and its value."""
    def part(field):
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(f) for f in fields]), 256)


def _hex(hashes: Column) -> Column:
    return F.lower(F.hex(hashes))


def _run(nodes: Column, first: Column, n) -> Column:
    return F.array_join(F.slice(nodes, first, n), "")


def _beside(nodes: Column, i: Column) -> Column:
    """The hashes left and right of a node in its run."""
    start = i - i % ARITY
    return F.struct(
        F.unhex(_run(nodes, start + 1, i - start)).alias("before"),
        F.unhex(_run(nodes, i + 2, start + ARITY - 1 - i)).alias("after"),
    )


def _linked(level: int, base: int) -> Column:
    """Nodes of one level of a block, each with its path to where it leads."""
    jump = (base + level) % STRIDE == 0
    steps = range(STRIDE if jump else 1)
    top = F.least(F.lit(level + len(steps)), F.col("depth"))

    def one(_, i):
        path = F.array(*[
            F.when(F.col("depth") > level + k, _beside(F.col(f"l{level + k}"), F.floor(i / ARITY ** k).cast("int"))) for k in steps
        ])
        return F.struct(
            F.lit(base + level).alias("level"), i.alias("at"), F.lit(jump).alias("jump"),
            (top + base).alias("top"), F.array_compact(path).alias("path"),
        )

    return F.transform(f"l{level}", one)


def _depth(size: Column) -> Column:
    """Levels above the leaves of a tree."""
    powers = F.array(*[F.lit(ARITY ** d).cast("long") for d in range(1, 40)])
    return F.size(F.filter(powers, lambda p: p < size)) + F.when(size > 1, 1).otherwise(0)


_LINKED = "array<struct<level:int,at:int,jump:boolean,top:int,path:array<struct<before:binary,after:binary>>>>"


def _build(stages: Stages, nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """From ``tree, size, at, hash`` of the lowest level: tables ``tree, level, at,
    jump, top, path`` of all nodes below the tops, and the tops ``tree, size, hash``.
    No tree has more than ``most`` leaves."""
    below, tops, base = [], None, 0
    while tops is None or ARITY ** base < most:
        depth = F.greatest(F.least(_depth(F.col("size")) - base, F.lit(BLOCK)), F.lit(0))
        blocks = nodes.groupBy("tree", "size", F.expr(f"at div {ARITY ** BLOCK}").alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("held")
        ).select("tree", "size", "block", depth.alias("depth"), F.transform("held", lambda h: _hex(h["hash"])).alias("l0"))
        for d in range(1, BLOCK + 1):
            last = F.col(f"l{d - 1}")
            runs = F.sequence(F.lit(0), F.ceil(F.size(last) / ARITY).cast("int") - 1)
            blocks = blocks.withColumn(f"l{d}", F.when(
                F.col("depth") >= d, F.transform(runs, lambda r: F.sha2(_run(last, r * ARITY + 1, ARITY), 256))
            ))
        blocks = stages.write(blocks)
        none = F.expr("array()").cast(_LINKED)
        found = blocks.withColumn("nodes", F.flatten(F.array(*[
            F.when(F.col("depth") > d, _linked(d, base)).otherwise(none) for d in range(BLOCK)
        ]))).select("tree", "block", F.explode_outer("nodes").alias("n")).filter(F.col("n").isNotNull()).select(
            "tree", "n.level",
            # a level has the block's nodes divided by the arity as often as it is above the base
            (F.col("block") * F.expr(f"cast(power({ARITY}, {BLOCK + base} - n.level) as long)") + F.col("n.at")).alias("at"),
            "n.jump", "n.top", "n.path",
        )
        below.append(found)
        top = F.coalesce(*[F.when(F.col("depth") == d, F.col(f"l{d}")[0]) for d in range(BLOCK + 1)])
        ends = blocks.select("tree", "size", F.col("block").alias("at"), F.unhex(top).alias("hash"))
        done = _depth(F.col("size")) <= base + BLOCK
        finished = ends.filter(done).select("tree", "size", "hash")
        tops = finished if tops is None else tops.unionByName(finished)
        nodes = ends.filter(~done)
        base += BLOCK
    return below, tops


def _named(nodes: DataFrame, above: bool) -> DataFrame:
    """Nodes with their ids, those of their parents and of where their paths lead."""
    shift = _ABOVE if above else 0

    def name(level):  # of the node's ancestor on that level
        at = F.expr(f"at div cast(power({ARITY}, {level} - level) as long)")
        return (F.col("tree") + at * F.expr(f"cast(power({ARITY}, {level}) as long)")) * _LEVELS + F.expr(level) + shift

    return nodes.select(
        name("level").alias("node"), name("level + 1").alias("parent"), (F.col("level") + shift).alias("level"), "at",
        "jump", name("top").alias("up"), "path",
    )


def build(stages: Stages, docs: DataFrame, keep: list[str], source: str = "source", doc_id: str = "doc_id") -> Manifest:
    """The manifest of ``docs``, which carries ``leaf`` (binary) and the columns
    ``keep`` besides source and id."""
    by_place = positions(stages, docs, [], [source, doc_id, "leaf"], "place")
    trees = by_place.groupBy(F.col(source).alias("_source")).agg(
        F.min("place").alias("tree"), F.count(F.lit(1)).alias("size")
    )
    leaves = stages.write(
        by_place.join(trees, F.col(source).eqNullSafe(F.col("_source")))
        .select("place", (F.col("place") * _LEVELS).alias("node"), "tree", "size", doc_id, *keep, "leaf"), keep=True
    )
    most = trees.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    below, tops = _build(
        stages, leaves.select("tree", "size", (F.col("place") - F.col("tree")).alias("at"), F.col("leaf").alias("hash")), most
    )
    subroots = positions(stages, tops, [], ["tree"], "at")
    count = subroots.count()
    above, root = _build(
        stages, subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"), "at", "hash"), count
    )
    # the lowest level of the tree over the sources are the subroots, which have ids already
    own = subroots.select("at", (F.col("tree") * _LEVELS + _depth(F.col("size"))).alias("own"))
    first = _named(above[0], above=True)
    upper = first.filter(F.col("level") == _ABOVE).join(own, "at").withColumn("node", F.col("own")).drop("own")
    upper = upper.unionByName(first.filter(F.col("level") > _ABOVE))
    for table in above[1:]:
        upper = upper.unionByName(_named(table, above=True))
    lower = _named(below[0], above=False)
    upper = upper.unionByName(lower.filter("level > 0"))
    for table in below[1:]:
        upper = upper.unionByName(_named(table, above=False))
    last = root.first()
    return Manifest(
        stages.write(lower.filter("level = 0").drop("at"), keep=True), stages.write(upper.drop("at"), keep=True),
        stages.write(subroots.select("tree", _hex(F.col("hash")).alias("subroot")), keep=True),
        last["hash"].hex() if last else None, leaves,
    )


def climb(lowest: DataFrame, jumps: DataFrame, starts: DataFrame) -> DataFrame:
    """``leaf, step, folded, siblings`` of every step from the rows of ``starts``
    (leaf, node, folded): step 0 has the hash it starts with, the last step the root
    that it leads to.  Only the first step reads the ``lowest`` level, which has most of
    the nodes; ``jumps`` are the upper nodes that a climb can stand at."""
    fold = """aggregate({path}, {c}.folded, (hash, run) ->
                unhex(sha2(concat(lower(hex(run.before)), lower(hex(hash)), lower(hex(run.after))), 256)))"""
    append = "aggregate({path}, CAST('' AS BINARY), (all, run) -> concat(all, run.before, run.after))"
    none = "coalesce(n.path, array())"  # a sole leaf is a subroot, which is no node of the lowest level
    return lowest.sparkSession.sql(
        f"""
        WITH RECURSIVE climb(leaf, node, folded, step, siblings) MAX RECURSION LEVEL {_LEVELS} AS (
          SELECT s.leaf, coalesce(n.up, s.node), {fold.format(path=none, c="s")}, 1, {append.format(path=none)}
          FROM {{starts}} s LEFT JOIN {{lowest}} n ON s.node = n.node
          UNION ALL
          SELECT c.leaf, n.up, {fold.format(path="n.path", c="c")}, c.step + 1, {append.format(path="n.path")}
          FROM climb c JOIN {{upper}} n ON c.node = n.node
        )
        SELECT leaf, step, folded, siblings FROM climb LIMIT ALL
        """,
        starts=starts, lowest=lowest.select("node", "up", "path"), upper=jumps.select("node", "up", "path"),
    )


def audit(docs: DataFrame, received: Column) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, folded_root, verified`` of every row of
    ``docs``.  The manifest is built from the rows as they are; each row climbs from
    the leaf that it has with ``received`` for its text, by the manifest's siblings.
    ``proof`` holds these, level by level and left to right, 32 bytes each."""
    stages = Stages(docs.sparkSession)
    own = leaf([F.col(f) for f in FIELDS])
    changed = leaf([F.col(f) if f != "text" else received for f in FIELDS])
    # a row that came as it was left starts from its own leaf, which is then stored once
    start = F.when(received.eqNullSafe(F.col("text")), F.lit(None)).otherwise(F.unhex(changed))
    hashed = stages.write(docs.select("doc_id", "source", start.alias("start"), F.unhex(own).alias("leaf")))
    manifest = build(stages, hashed, ["start"])
    jumps = stages.write(manifest.upper.filter("jump"), keep=True)  # so few that Spark sees their size
    stages.close()
    leaves = manifest.leaves
    steps = climb(manifest.lowest, jumps, leaves.select(F.col("place").alias("leaf"), "node", F.coalesce("start", "leaf").alias("folded")))
    climbed = steps.groupBy(F.col("leaf").alias("place")).agg(
        F.array_sort(F.collect_list(F.struct("step", "siblings"))).alias("siblings"), F.max_by("folded", "step").alias("folded")
    )
    return leaves.join(climbed, "place").join(manifest.trees, "tree").select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), "subroot", F.lit(manifest.root).alias("root"),
        F.aggregate("siblings", F.lit("").cast("binary"), lambda all_, s: F.concat(all_, s["siblings"])).alias("proof"),
        _hex(F.col("folded")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
