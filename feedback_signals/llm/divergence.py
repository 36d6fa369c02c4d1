"""How far the sources of a language differ in their words: an exact divergence for
every pair of sources, computed in a cube.

Terms are runs of letters (ASCII letters and everything outside ASCII), lower-cased in
A-Z.  A language keeps the terms that occur in at least ``MIN_DOCS`` of its documents.
Each group (language, source), and each language, has a weight for each kept term,
``p = 1 + floor(SCALE * (count + 2) / (N + 2 * V))``; the divergence of two is the sum
of ``floor((p - q)^2 / (p + q))`` over all kept terms, in whole numbers.

The work is a cube of cells (group block, group block, term block).  Every group's
weights are cut into slices by term block, and a slice is copied to each cell in the
row and column of its block; a task adds up the divergences of a cell's pairs over the
cell's terms, and cells are summed along the term axis.  Terms that no group of a
cell has are not shipped: they add one amount per pair and term.  A cell holds at
most 2 * ``GROUPS`` slices of ``TERMS`` terms, whatever the corpus.

Counts are combined before anything is shuffled, and a term's count in a group is one
row, so neither a frequent term nor a large source makes a large group.

Rows: null text, language and source count as empty; every row is a document, also
if it repeats another; a group without kept terms takes part with counts of zero, and
in a language without kept terms all values are zero.  A language with one source
has no pairs.  Ties in value are ranked by item, in UTF-8 order.  An empty table gives
an empty result; further columns are ignored, whatever their names.  Very long texts
are one row of words.  Sums are exact; a term with more than 9 * 10**9 occurrences in
a language would overflow, which raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Stages
from .ordering import positions

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
#: Groups and terms in a block.
GROUPS = 16
TERMS = 4096
_BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _weight(count: str, total: str) -> Column:
    return F.expr(f"1 + ({SCALE} * ({count} + 2L)) div greatest({total} + 2L * terms, 1L)")


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, count, docs``: occurrences, and documents with the term."""
    words = F.split(F.translate("text", _UPPER, _LOWER), _BREAKS)
    # all words, then each distinct one once more: both counts come from one pass
    rows = docs.select("lang", "source", words.alias("words")).select(
        "lang", "source", F.size("words").alias("n"), F.concat("words", F.array_distinct("words")).alias("words")
    )
    each = rows.select("lang", "source", "n", F.posexplode_outer("words").alias("at", "term")).filter(F.col("term") != "")
    word = (F.col("at") < F.col("n")).cast("long")
    return each.groupBy("lang", "source", "term").agg(F.sum(word).alias("count"), F.sum(1 - word).alias("docs"))


def _cell(terms: int):
    """Partial sums of one cell: ``lang, a, b, part`` for its pairs of groups.  A row
    without a term stands for its group and holds the weight of a term it lacks."""
    def solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, row, column, block = (k.as_py() for k in key)
        side, group, at, weight, kept = (
            table.column(c).to_numpy() for c in ("side", "group", "at", "weight", "kept")
        )
        head = at < 0
        width = max(0, min(terms, int(kept[0]) - block * terms))
        seen, spot = np.unique(at[~head], return_inverse=True)
        blocks = []
        for s in (0, 1):
            mine = head & (side == s)
            order = np.argsort(group[mine])
            groups, lacking = group[mine][order], weight[mine][order]
            # the last column stands for the terms that no group of the cell has
            held = np.repeat(lacking[:, None], len(seen) + 1, axis=1)
            body = (side == s)[~head]
            held[np.searchsorted(groups, group[~head][body]), spot[body]] = weight[~head][body]
            blocks.append((groups, held))
        (left, p), (right, q) = blocks
        if row == column:
            right, q = left, p
        times = np.ones(len(seen) + 1, dtype=np.int64)
        times[-1] = width - len(seen)
        a, b, parts = [], [], []
        for i in range(len(left)):
            part = ((p[i] - q) ** 2 // (p[i] + q) * times).sum(axis=1)
            pair = right > left[i]
            a += [int(left[i])] * int(pair.sum())
            b += right[pair].tolist()
            parts += part[pair].tolist()
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.int64()),
                         "b": pa.array(b, pa.int64()), "part": pa.array(parts, pa.int64())})

    return solve


class Audit:
    """The counts of a corpus and what is asked of them; tables are in the shared folder."""

    def __init__(
        self, docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
        min_docs: int = MIN_DOCS, groups: int = GROUPS, terms: int = TERMS,
    ):
        self._groups, self._terms = groups, terms
        stages = Stages(docs.sparkSession)
        whole = docs.select(*[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
            for c, name in ((text, "text"), (lang, "lang"), (source, "source"))
        ])
        counted = stages.write(term_counts(whole))
        common = counted.groupBy("lang", "term").agg(
            F.sum("docs").alias("docs"), F.sum("count").alias("lang_count")
        ).filter(F.col("docs") >= min_docs).select("lang", "term", "lang_count")
        kept = positions(stages, common, ["lang"], ["term"], "at")
        #: lang, source, term, count, and the term's number and count in its language
        self.counts = stages.write(counted.join(kept, ["lang", "term"]).select(
            "lang", "source", "term", "count", "at", "lang_count"
        ), keep=True)
        in_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_count").alias("lang_total"))
        in_group = self.counts.groupBy("lang", "source").agg(F.sum("count").alias("total"))
        present = whole.select("lang", "source").distinct()
        numbered = positions(stages, present, ["lang"], ["source"], "group")
        #: lang, source, the group's number and total, and its language's kept terms, total and groups
        self.groups = stages.write(
            numbered.join(in_lang, "lang", "left").join(in_group, ["lang", "source"], "left")
            .join(numbered.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")), "lang")
            .fillna(0, ["terms", "lang_total", "total"]), keep=True,
        )
        stages.close()

    def _cells(self, slices: DataFrame) -> DataFrame:
        """A copy of each slice for every cell in the row and column of its block."""
        last = F.floor((F.col("groups") - 1) / self._groups)
        own = F.floor(F.col("group") / self._groups)
        return slices.withColumn("own", own).withColumn("other", F.explode_outer(F.sequence(F.lit(0).cast("long"), last))).select(
            "lang", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("column"), "block",
            (F.col("own") > F.col("other")).cast("int").alias("side"), "group", "at", "weight", F.col("terms").alias("kept"),
        )

    def pairs(self) -> DataFrame:
        """``lang, source, other, value`` for each two sources of a language, both ways."""
        heads = self.groups.withColumn("block", F.explode_outer(F.sequence(
            F.lit(0).cast("long"), F.floor(F.greatest(F.col("terms") - 1, F.lit(0)) / self._terms)
        ))).select("lang", "group", "groups", "terms", "block", F.lit(-1).cast("long").alias("at"), _weight("0", "total").alias("weight"))
        bodies = self.counts.join(self.groups, ["lang", "source"]).select(
            "lang", "group", "groups", "terms", F.floor(F.col("at") / self._terms).alias("block"), "at",
            _weight("count", "total").alias("weight"),
        )
        parts = self._cells(heads.unionByName(bodies)).groupBy("lang", "row", "column", "block").applyInArrow(
            _cell(self._terms), "lang string, a long, b long, part long"
        )
        values = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
        both = values.select("lang", "value", F.explode_outer(F.array(
            F.struct(F.col("a").alias("group"), F.col("b").alias("with")), F.struct(F.col("b").alias("group"), F.col("a").alias("with")),
        )).alias("pair")).select("lang", "value", "pair.*")
        names = self.groups.select("lang", "group", "source")
        return both.join(names, ["lang", "group"]).join(
            names.withColumnsRenamed({"group": "with", "source": "other"}), ["lang", "with"]
        ).select("lang", "source", "other", "value")

    def terms(self) -> DataFrame:
        """``lang, source, term, value`` of kept terms that a group uses more than its
        language does."""
        return self.counts.join(self.groups, ["lang", "source"]).select(
            "lang", "source", "term", _weight("count", "total").alias("p"), _weight("lang_count", "lang_total").alias("q")
        ).filter("p > q").select("lang", "source", "term", _divergence("p", "q").alias("value"))

    def report(self, top_terms: int = TOP_TERMS) -> DataFrame:
        """``lang, source, part, item, value, rank``: every other source of the language
        (part ``pair``) and the terms that set the group apart most (part ``term``)."""
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        pairs = self.pairs().withColumnRenamed("other", "item").withColumn("rank", F.row_number().over(order))
        terms = self.terms().withColumnRenamed("term", "item").withColumn("rank", F.row_number().over(order)).filter(
            F.col("rank") <= top_terms
        )
        columns = ["lang", "source", "part", "item", "value", "rank"]
        return pairs.withColumn("part", F.lit("pair")).select(*columns).unionByName(
            terms.withColumn("part", F.lit("term")).select(*columns)
        )
