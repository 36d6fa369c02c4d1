"""Row filters, role detection by vocabulary, wide-to-long and list-to-rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions import text as X


def named(column: str) -> Column:
    """A column by its exact name, dots and leading spaces included."""
    return F.col("`" + column.replace("`", "``") + "`")


def combine_text(df: DataFrame, columns: Sequence[str], force: bool = False) -> DataFrame:
    """Adds ``text`` from ``columns`` unless the table already has one
    (``force`` rebuilds it)."""
    if "text" in df.columns and not force:
        return df
    return df.withColumn("text", X.combined_text([named(c) for c in columns]))


def drop_short(df: DataFrame, min_chars: int = 5, strip: bool = False, col: str = "text") -> DataFrame:
    return df.filter(X.longer_than(F.col(col), min_chars, strip))


def drop_noise(df: DataFrame, col: str = "text") -> DataFrame:
    return df.filter(X.is_meaningful(F.col(col))).withColumn(col, X.strip(F.col(col)))


def anonymize(
    df: DataFrame, col: str = "text", placeholder: str = C.DEFAULTS.placeholder, ner=None
) -> DataFrame:
    """Replace person names.  ``ner`` is an optional scalar pandas UDF from text
    to ``array<struct<start:int,end:int>>`` (0-based character spans); without
    it capitalised name pairs are replaced by a regular expression."""
    if ner is None:
        return df.withColumn(col, X.masked_names(F.col(col), placeholder))
    # Spans are applied from the end, so that earlier offsets stay valid.
    spans = F.sort_array(F.col("_spans"), asc=False)
    masked = F.aggregate(
        spans,
        F.col(col),
        lambda text, s: F.concat(
            F.substring(text, F.lit(1), s["start"]),
            F.lit(placeholder),
            F.substring(text, s["end"] + 1, F.length(text)),
        ),
    )
    blank = F.coalesce(F.length(X.strip(F.col(col))) == 0, F.lit(True))
    found = df.withColumn("_spans", ner(F.col(col)))
    return found.withColumn(col, F.when(blank, F.col(col)).otherwise(masked)).drop("_spans")


_EDGES = "first_row long, head string, tail string, full boolean, found array<string>"


def _spanning(phrases: Sequence[str], reach: int):
    """Folds the edges of texts in order: which phrases run over from one text to the
    next, and the outer edges of the whole run."""
    def extended(carry: str | None, text: str) -> str:
        return text if carry is None else f"{carry} {text}"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, head, carry, full, found = None, None, None, False, set()
        for batch in batches:
            for row, start, end, short in zip(*(batch.column(i).to_pylist() for i in range(4))):
                first = row if first is None else first
                if carry is not None:
                    seam = extended(carry, start)
                    found.update(p for p in phrases if p in seam)
                if not full:
                    head = extended(head, start)
                    full = not short or len(head) >= reach
                carry = extended(carry, end)[-reach:] if short else end
        if first is not None:
            yield pa.RecordBatch.from_arrays([
                pa.array([first], pa.int64()), pa.array([head[:reach]]), pa.array([carry]), pa.array([full]),
                pa.array([sorted(found)], pa.list_(pa.string())),
            ], ["first_row", "head", "tail", "full", "found"])

    return fold


def _phrases_across_texts(texts: DataFrame, phrases: Sequence[str], row_id: str) -> set[str]:
    """Phrases that occur only where one text (column ``t``) follows another.  Only the
    texts' edges are ordered, and one row per range of ids reaches the driver."""
    phrases = [p for p in phrases if " " in p]
    if not phrases:
        return set()
    reach = max(map(len, phrases))
    edges = texts.select(
        F.col(row_id).cast("long").alias("row"), F.left("t", F.lit(reach)).alias("start"), F.right("t", F.lit(reach)).alias("end"),
        (F.length("t") < reach).alias("short"),
    ).repartitionByRange("row").sortWithinPartitions("row")
    found, carry = set(), None
    for run in sorted(edges.mapInArrow(_spanning(phrases, reach), _EDGES).collect(), key=lambda r: r["first_row"]):
        found.update(run["found"])
        if carry is not None:
            found.update(p for p in phrases if p in f"{carry} {run['head']}")
        carry = run["tail"] if run["full"] or carry is None else f"{carry} {run['tail']}"[-reach:]
    return found


def detect_feedback_mode(
    df: DataFrame,
    peer: Sequence[str] = C.PEER_SIGNALS,
    professor: Sequence[str] = C.PROFESSOR_SIGNALS,
    row_id: str = "row_id",
) -> DataFrame:
    """One row: which vocabulary the texts of the whole table use.  Ties and an empty
    table count as peer feedback.

    The texts count as joined by blanks in the order of ``row_id``, so a phrase may span
    several of them.  Phrases inside a text are one map-side combined aggregate.
    """
    texts = df.filter(F.col("text").isNotNull()).select(row_id, F.lower("text").alias("t"))
    across = _phrases_across_texts(texts, [*peer, *professor], row_id)
    score = lambda phrases: X.total(
        F.coalesce(F.bool_or(F.col("t").contains(p) | F.lit(p in across)), F.lit(False)).cast("int") for p in phrases
    )
    scored = texts.agg(score(peer).alias("peer_score"), score(professor).alias("professor_score"))
    is_peer = F.col("peer_score") >= F.col("professor_score")
    return scored.withColumn("feedback_mode", F.when(is_peer, C.S2S).otherwise(C.S2P))


def feedback_mode_of(df: DataFrame, **kwargs) -> str:
    return detect_feedback_mode(df, **kwargs).first().feedback_mode


def melt_dimensions(
    df: DataFrame,
    pairs: Sequence[tuple[str, str, str]],
    min_chars: int = 5,
    keep: Sequence[str] = (),
    min_pairs: int = 2,
) -> DataFrame:
    """One row per (source row, pair) with ``rating, text, dimension`` and the
    ``keep`` columns; one scan, no union.  Too few pairs leave ``df`` unchanged."""
    if len(pairs) < min_pairs:
        return df
    rows = F.array(*[
        F.struct(
            named(rating).cast("double").alias("rating"),
            named(text).cast("string").alias("text"),
            F.lit(dimension).alias("dimension"),
        )
        for rating, text, dimension in pairs
    ])
    # Short texts go before the explode, so empty cells never become rows.
    kept = F.filter(rows, lambda r: X.longer_than(r["text"], min_chars, stripped=True))
    carried = [named(c) for c in keep if c not in ("rating", "text", "dimension")]
    return df.select(*carried, F.explode(kept).alias("r")).select(*carried, "r.rating", "r.text", "r.dimension")


def split_categories(df: DataFrame, col: str = "minority_category") -> DataFrame:
    """One row per category of the ``|``-joined list, as ``category``."""
    parts = F.filter(
        F.transform(F.split(F.col(col), r"\|"), lambda c: X.strip(c)), lambda c: c != ""
    )
    return df.withColumn("category", F.explode(parts))


def resolve_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in columns), None)


def signal_entity_column(columns: Sequence[str]) -> str | None:
    """Entity column used for mixed signals."""
    return resolve_column(columns, C.SIGNAL_ENTITY_COLUMNS)


def summary_entity_column(columns: Sequence[str]) -> str:
    """Entity column used for summaries, with its two fall-backs."""
    return resolve_column(columns, (*C.SUMMARY_ENTITY_COLUMNS, "dimension")) or "feedback_mode"
