"""Labelling texts by their closeness to candidate descriptions.

A scorer is a function ``(text column, candidates) -> array<double> column`` with
one score per candidate: a pandas or Arrow UDF around a model, or the built-in
``token_cosine``, which is a plain expression.  A null in place of the array says
that the text gives no evidence for any candidate; such a text gets no label.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import labels as L
from ..functions.text import strip
from .caches import score_distinct, with_key
from .labelling import first_label_per_text, map_labels

Scorer = Callable[[Column, Sequence[str]], Column]

_WEIGHT_SCALE = 1000


def candidate_words(candidate: str) -> list[str]:
    return sorted(set(re.findall("[a-z]+", candidate.lower())))


def word_weights(candidates: Sequence[str]) -> dict[str, int]:
    """Squared inverse-document-frequency weight of each candidate word, scaled
    to an integer so that sums do not depend on their order."""
    words = [candidate_words(c) for c in candidates]
    frequency: dict[str, int] = {}
    for group in words:
        for word in group:
            frequency[word] = frequency.get(word, 0) + 1
    idf = lambda df: math.log((1 + len(candidates)) / (1 + df)) + 1
    return {w: round(_WEIGHT_SCALE * idf(df) ** 2) for w, df in sorted(frequency.items())}


def token_cosine(text: Column, candidates: Sequence[str]) -> Column:
    """Cosine between the words of a text and of each candidate, in the space of
    the candidates' words.

    The whole text is read once, by a hashed intersection with that vocabulary.
    Every word found adds its row of per-candidate weights to a running sum,
    whose last entry is the text's own squared length.  A text without any word of
    the candidates scores null.
    """
    weight = word_weights(candidates)
    words = [set(candidate_words(c)) for c in candidates]
    # The weight table is one parsed literal: a call per number would cost more
    # than the query.  Words are plain a-z.
    doubles = lambda values: "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"
    entries = (
        f"'{w}', {doubles([*[q if w in group else 0 for group in words], q])}" for w, q in weight.items()
    )
    rows = F.expr(f"map({', '.join(entries)})")
    vocabulary = F.expr("array(" + ", ".join(f"'{w}'" for w in weight) + ")")
    hits = F.array_intersect(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), vocabulary)
    sums = F.aggregate(
        hits, F.expr(doubles([0] * (len(candidates) + 1))),
        lambda acc, word: F.zip_with(acc, rows[word], lambda x, y: x + y),
    )
    norms = [math.sqrt(sum(weight[w] for w in group)) if group else 1.0 for group in words]
    # A transform over one element binds the sums, so they are computed once.
    return F.get(F.transform(F.array(sums), lambda s: _scaled(s, F.expr(doubles(norms)))), F.lit(0))


def _scaled(sums: Column, norms: Column) -> Column:
    own = F.sqrt(F.element_at(sums, -1))
    shared = F.slice(sums, 1, F.size(norms))
    return F.when(own > 0, F.zip_with(shared, norms, lambda s, n: s / n / own))


def argmax_position(scores: Column) -> Column:
    """0-based position of the highest score; ties go to the first.  Null without scores."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def argmax_label(scores: Column, names: Sequence[str]) -> Column:
    return F.get(F.array(*map(F.lit, names)), argmax_position(scores))


def best_candidate(df: DataFrame, candidates: Sequence[str], scorer: Scorer | None = None, text: str = "text") -> DataFrame:
    """Adds ``candidate`` and its ``score`` to every row, null where there is no evidence."""
    scored = df.withColumn("_scores", (scorer or token_cosine)(F.col(text), candidates))
    return scored.withColumns({
        "candidate": argmax_label(F.col("_scores"), candidates),
        "score": F.array_max("_scores"),
    }).drop("_scores")


def candidates_for(mode: str, subtype: str | None = None) -> dict[str, str]:
    """Candidate descriptions of a feedback mode, with the label of each."""
    if mode == C.S2S:
        return C.CANDIDATE_LABELS.get(subtype or C.PEER, C.PEER_CANDIDATES)
    return C.PROFESSOR_CANDIDATES


def zero_shot_label(
    df: DataFrame,
    candidates: Mapping[str, str] | Sequence[str],
    scorer: Scorer | None = None,
    cache_path: str | None = None,
    blank_stays_empty: bool = True,
    default: str | None = None,
    name: str = "sentiment",
) -> DataFrame:
    """One label per distinct text among ``candidates``.

    A model only sees distinct texts that the cache does not hold.  The built-in
    scorer is cheaper than the shuffle this needs, so without a cache it runs in
    place.  ``default`` is the label of an unmapped candidate, its own name if
    ``None``, and of a text without evidence, which otherwise stays unlabelled and
    is not recorded in the cache.
    """
    mapping = candidates if isinstance(candidates, Mapping) else {c: c for c in candidates}
    blank = F.length(strip(F.coalesce("text", F.lit("")))) == 0

    def label(texts: DataFrame) -> DataFrame:
        best = map_labels(best_candidate(texts, list(mapping), scorer), mapping, default)
        value = F.when(blank, "").otherwise(F.col("label")) if blank_stays_empty else F.col("label")
        return best.withColumn(name, value).drop("candidate", "score", "label")

    filled = df.withColumn("text", F.coalesce("text", F.lit("")))
    if scorer is None and cache_path is None:
        return label(filled)
    return score_distinct(filled, name, label, cache_path).drop("text_hash")


def zero_shot_multi(
    df: DataFrame,
    candidates: Sequence[str] | None = None,
    threshold: float = C.DEFAULTS.multi_label_threshold,
    scorer: Scorer | None = None,
) -> DataFrame:
    """Adds ``categories``: every candidate scoring at least ``threshold``,
    joined by ``|``, or the outlier-only mark."""
    if candidates is None:
        candidates = [c for c in C.MINORITY_CATEGORIES if c not in C.NON_EXPERIENCE_CATEGORIES]
    scored = df.withColumn("_scores", (scorer or token_cosine)(F.col("text"), candidates))
    picks = F.array_compact(F.array(*[
        F.when(F.get("_scores", F.lit(i)) >= threshold, F.lit(c)) for i, c in enumerate(candidates)
    ]))
    joined = F.array_join(picks, "|")
    return scored.withColumn(
        "categories", F.when(joined == "", C.OUTLIER_ONLY).otherwise(joined)
    ).drop("_scores")


def dimension_candidates(df: DataFrame, strict_keys: bool = False) -> DataFrame:
    """Adds ``rating_bucket`` and ``candidates``, the descriptions allowed for
    the row's dimension and rating.  Dimension names are compared without
    underscores unless ``strict_keys``."""
    described = {label: text for text, label in C.PROFESSOR_CANDIDATES.items()}
    table = F.create_map(*[
        x for (dimension, bucket), labels in C.DIMENSION_LABELS.items()
        for x in (F.lit(f"{dimension}/{bucket}"), F.array(*[F.lit(described[l]) for l in labels]))
    ])
    dimension = F.lower("dimension")
    if not strict_keys:
        dimension = F.replace(dimension, F.lit("_"), F.lit(""))
    bucketed = df.withColumn("rating_bucket", L.rating_bucket(F.col("rating")))
    key = F.concat_ws("/", dimension, F.col("rating_bucket"))
    return bucketed.withColumn(
        "candidates", F.coalesce(table[key], F.array(F.lit(C.GENERIC_CANDIDATE)))
    )


def label_by_dimension(
    df: DataFrame,
    scorer: Scorer | None = None,
    strict_keys: bool = False,
    default: str = "Majority_Positive",
) -> DataFrame:
    """``sentiment`` of course-evaluation rows among the candidates of their
    dimension.  Rows with one candidate need no scoring, a text without evidence
    takes the first candidate of its rating, and the first row of a text decides for
    all rows with that text."""
    universe = list(C.PROFESSOR_CANDIDATES)
    trimmed = df.withColumn("text", strip(F.col("text")))
    offered = dimension_candidates(trimmed, strict_keys)
    index = F.create_map(*[x for i, c in enumerate(universe) for x in (F.lit(c), F.lit(i))])
    allowed = F.transform("candidates", lambda c: F.get("_scores", index[c]))
    chosen = F.get("candidates", argmax_position(allowed))
    score = (scorer or token_cosine)(F.col("text"), universe)
    choose = lambda rows, s: rows.withColumn("_scores", s).withColumn("candidate", chosen).drop("_scores")
    several = F.size("candidates") > 1
    if scorer is None:
        # An expression is only evaluated where it is asked for: one scan.
        named = choose(offered, F.when(several, score))
    else:
        # A UDF runs on every row it is given: rows are split before it.
        single = offered.filter(~several).withColumn("candidate", F.lit(None).cast("string"))
        named = single.unionByName(choose(offered.filter(several), score))
    named = named.withColumn("candidate", F.coalesce("candidate", F.col("candidates")[0]))
    labelled = map_labels(named, C.PROFESSOR_CANDIDATES, default)
    settled = first_label_per_text(with_key(labelled), "label")
    return settled.withColumn("sentiment", F.col("label")).drop(
        "label", "candidate", "candidates", "rating_bucket", "text_hash"
    )
