"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``1101100101`` slides over the words of a text and hashes the words
under its ones, so a substituted word under a zero does not disturb it.  Hashes of
the documents are joined with hashes of the benchmark; each hit fixes an alignment
(document start of the item), and the words along it are compared: a window of
``window`` words (the whole item, if shorter) must agree in at least ``min_ratio``
of its words.  Hashes travel without their text; only documents with a hit are read
again.

The seeds are complete: whichever words the rule lets differ, one seed is left.  For
the standard window the three ``MASKS`` slide; an item shorter than the window has
masks of its own length, chosen until every permitted substitution leaves one of them
whole (`masks_for`), and another window has masks of its length alike.

Words are the runs of letters and digits of the lower-cased text.  Items without words match
nothing, and neither do null or empty texts; rows without an id are not reported.  Repeated rows give repeated verdicts
folded into one row per (doc_id, item_id).  Empty tables give an empty result;
further columns are ignored, whatever their names.

The seeds of the benchmark are broadcast while they are at most ``BROADCAST_SEEDS``
(checked); beyond that the hashes are joined by shuffle.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from ..session import Stages

#: Masks of weight 6 over ten words; in 13 words any two may differ.
MASKS = ("1111100001", "1110110001", "1001011101")
WEIGHT = 6
WINDOW = 13
MIN_RATIO = 0.8
BROADCAST_SEEDS = 500_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def word_keys(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _left(mask: str, size: int, changed: tuple[int, ...]) -> bool:
    """Whether the mask, slid over ``size`` words, has a place without a changed word."""
    ones = [i for i, bit in enumerate(mask) if bit == "1"]
    return any(all(at + i not in changed for i in ones) for at in range(size - len(mask) + 1))


def complete(masks: tuple[str, ...], size: int, permitted: int) -> bool:
    """Whether one mask is left whichever ``permitted`` of ``size`` words differ."""
    return all(any(_left(mask, size, changed) for mask in masks) for changed in combinations(range(size), permitted))


def permitted_changes(size: int, min_ratio: float) -> int:
    return size - max(1, ceil(min_ratio * size))


def masks_for(size: int, permitted: int) -> tuple[str, ...]:
    """A complete set of masks for ``size`` words."""
    if not permitted and size <= WINDOW:
        return ("1" * size,)
    if size > WINDOW or permitted > 2:  # of permitted + 1 runs of words one is untouched
        return ("1" * max(1, size // (permitted + 1)),)
    zeros = size - min(WEIGHT, size - permitted)
    open_sets = set(combinations(range(size), permitted))
    masks = []
    while open_sets:
        best = max(combinations(range(size), zeros), key=lambda gap: len(open_sets.intersection(combinations(gap, permitted))))
        open_sets.difference_update(combinations(best, permitted))
        masks.append("".join("0" if i in best else "1" for i in range(size)))
    return tuple(masks)


def _plan(window: int, short: list[int], min_ratio: float) -> dict[int, tuple[str, ...]]:
    """Masks per size: the window, and each length of a shorter item."""
    plan = {n: masks_for(n, permitted_changes(n, min_ratio)) for n in short}
    changes = permitted_changes(window, min_ratio)
    small = window <= WINDOW and changes <= 2
    plan[window] = MASKS if small and complete(MASKS, window, changes) else masks_for(window, changes)
    return plan


def _grams(df: DataFrame, masks: tuple[str, ...], keep: list[str]) -> DataFrame:
    """One row per position and mask: ``keep``, ``at`` (0-based) and ``seed``."""
    span = len(masks[0])
    n = F.size("keys") - F.lit(span - 1)
    columns = [F.slice("keys", j + 1, F.greatest(n, F.lit(0))) for j in range(span)]
    zipped = F.arrays_zip(*[c.alias(f"w{j}") for j, c in enumerate(columns)])
    rows = df.filter(F.size("keys") >= span).select(*keep, F.posexplode(zipped).alias("at", "gram"))
    seeds = [
        F.xxhash64(F.lit(int(mask, 2)), *[F.col("gram")[f"w{j}"] for j in range(span) if mask[j] == "1"])
        for mask in masks
    ]
    if len(seeds) == 1:
        return rows.select(*keep, "at", seeds[0].alias("seed"))
    return rows.select(*keep, "at", F.explode(F.array(*seeds)).alias("seed"))


def _seeds(df: DataFrame, plan: dict[int, tuple[str, ...]], keep: list[str]) -> DataFrame:
    rows = None
    for masks in dict.fromkeys(plan.values()):
        one = _grams(df, masks, keep)
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _agreement(doc: Column, item: Column, start: Column, begin: Column, length: Column) -> Column:
    """Equal words of the document and item at item positions begin .. begin + length."""
    pairs = F.arrays_zip(F.slice(doc, start + begin + 1, length).alias("x"), F.slice(item, begin + 1, length).alias("y"))
    return F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))


def _verified(hit: Column, keys: Column, window: int, min_ratio: float) -> Column:
    """The best window of an alignment as (matched_words, -doc_start, ...), else null."""
    item, start = hit["item_keys"], hit["start"]
    size = F.least(F.lit(window), F.size(item))
    first = F.greatest(F.lit(0), -start)  # item words that have a partner in the document
    last = F.least(F.size(item), F.size(keys) - start) - size
    best = F.array_max(F.transform(
        F.when(last >= first, F.sequence(first, last)), lambda b: _agreement(keys, item, start, b, size)
    ))
    return F.when(best >= F.ceil(F.lit(min_ratio) * size), F.struct(
        hit["item_id"].alias("item_id"), best.alias("matched_words"), (-start).alias("order"),
        size.alias("window_words"), F.size(item).alias("item_words"),
    ))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    window: int = WINDOW,
    min_ratio: float = MIN_RATIO,
) -> DataFrame:
    """``doc_id, item_id, matched_words, window_words, item_words, doc_start``: one
    row per document and benchmark item that overlap, with the best window."""
    stages = Stages(docs.sparkSession)
    items = stages.write(benchmark.select(
        F.col(item_id).alias("item_id"), word_keys(F.col(item_text)).alias("keys")
    ).filter(F.size("keys") > 0), keep=True)
    size = F.size("keys")
    short = sorted(r[0] for r in items.filter(size < window).select(size).distinct().collect())
    plan = _plan(window, short, min_ratio)
    # A short item is only sought whole, so it is hashed by the masks of its own length alone.
    wanted = _grams(items.filter(size >= window), plan[window], ["item_id"])
    for n in short:
        wanted = wanted.unionByName(_grams(items.filter(size == n), plan[n], ["item_id"]))
    wanted = stages.write(wanted.select("seed", "item_id", F.col("at").alias("item_at")))
    if wanted.count() <= BROADCAST_SEEDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(doc_id).alias("doc_id"), word_keys(F.col(text)).alias("keys"))
    hits = stages.write(
        _seeds(texts, plan, ["doc_id"]).join(wanted, "seed")
        .select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("start")).distinct(),
        keep=True,
    )
    stages.close()
    by_doc = hits.join(items.withColumnRenamed("keys", "item_keys"), "item_id").groupBy("doc_id").agg(
        F.collect_list(F.struct("item_id", "start", "item_keys")).alias("hits")
    )
    verified = F.transform("hits", lambda hit: _verified(hit, F.col("keys"), window, min_ratio))
    return (
        texts.join(by_doc, "doc_id").select("doc_id", F.explode(verified).alias("hit"))
        .filter(F.col("hit").isNotNull()).groupBy("doc_id", "hit.item_id")
        .agg(F.max(F.struct("hit.matched_words", "hit.order", "hit.window_words", "hit.item_words")).alias("best"))
        .select(
            "doc_id", "item_id", "best.matched_words", "best.window_words", "best.item_words",
            (-F.col("best.order")).alias("doc_start"),
        )
    )
