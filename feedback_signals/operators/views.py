"""Read side: browsing, top-k lists, review and export shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .aggregates import category_breakdown, count_if, run_summary
from .lookup import attach

PAGE = 50
REVIEW_PAGE = 15
PANEL_ROWS = 100
MISMATCH_ROWS = 50
PAGE_CAP = 10_000
LABEL_SORTS = {
    "count": "count", "pct": "pct", "confidence": "avg_confidence",
    "minority": "minority_count", "label": "label",
}


def _mentions(column: str, search: str) -> Column:
    return F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(search.lower()))


def by_priority(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("priority_score"), "row_id")


def priority_alerts(df: DataFrame, k: int = 100) -> DataFrame:
    return by_priority(df).limit(k)


def priority_key() -> Column:
    """A key whose ascending order is that of ``by_priority``."""
    score = F.col("priority_score")
    return F.struct(score.isNull().alias("unscored"), (-score).alias("low"), F.col("row_id").alias("row_id"))


def is_priority_alert(df: DataFrame, k: int = 100) -> Column:
    """Whether a row of ``df`` is one of ``priority_alerts``, as a condition, so that
    the row need not be sorted.  The last key that belongs to them comes from a pass
    over two columns in which every task keeps ``k`` keys.  Rows that share the last
    key (a repeated ``row_id``) all belong."""
    first = df.select(priority_key().alias("key")).orderBy("key").limit(k)
    return F.coalesce(priority_key() <= first.agg(F.max("key")).scalar(), F.lit(False))


def browse(
    df: DataFrame,
    search: str = "",
    label: str | None = None,
    minority: bool | None = None,
    sort_key: str = "confidence",
    asc: bool = False,
    page: int = 0,
    size: int = PAGE,
) -> DataFrame:
    """One page of the filtered, sorted table; the filter sees every row."""
    rows = df.filter(_mentions("text", search)) if search.strip() else df
    if label is not None:
        rows = rows.filter(F.col("prediction") == label)
    if minority is not None:
        flag = F.coalesce("is_minority_pattern", F.lit(False))
        rows = rows.filter(flag if minority else ~flag)
    key = F.asc(sort_key) if asc else F.desc(sort_key)
    return rows.orderBy(key, "row_id").offset(page * size).limit(size)


def browse_labels(stats: DataFrame, search: str = "", sort: str = "count", asc: bool = False) -> DataFrame:
    """Label statistics that match ``search``.  Numbers sort descending and
    names ascending unless ``asc`` turns the order around."""
    column = LABEL_SORTS[sort]
    ascending = asc != (sort == "label")
    rows = stats.filter(_mentions("label", search))
    return rows.orderBy(F.asc(column) if ascending else F.desc(column), "label")


def search_minority(df: DataFrame, search: str = "", limit: int = PANEL_ROWS) -> DataFrame:
    flagged = df.filter(F.col("is_minority_pattern"))
    if search.strip():
        flagged = flagged.filter(_mentions("text", search) | _mentions("minority_category", search))
    return flagged.orderBy("row_id").limit(limit)


def review_decision(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """``human_label`` from ``(row_id, decision)`` corrections."""
    decided = attach(df, corrections.select("row_id", "decision"), "row_id")
    human = F.when(F.col("decision") == "approved", F.col("prediction")).when(
        F.col("decision") == "rejected", "REJECTED"
    ).otherwise("")
    return decided.withColumn("human_label", human)


def review_queue(
    df: DataFrame, corrections: DataFrame, state: str = "all", page: int = 0, size: int = REVIEW_PAGE
) -> DataFrame:
    """A page of the rows that need review, by state of review."""
    rows = review_decision(df.filter("needs_review"), corrections)
    if state == "pending":
        rows = rows.filter(F.col("decision").isNull())
    elif state != "all":
        rows = rows.filter(F.col("decision") == state)
    return rows.orderBy("row_id").offset(page * size).limit(size)


def review_progress(df: DataFrame, corrections: DataFrame) -> DataFrame:
    rows = review_decision(df.filter("needs_review"), corrections)
    decision = F.col("decision")
    return rows.agg(
        F.count("*").alias("total"),
        count_if(decision.isNotNull()).alias("reviewed"),
        count_if(decision == "approved").alias("approved"),
        count_if(decision == "rejected").alias("rejected"),
        count_if(decision.isNull()).alias("pending"),
    )


def mismatch_view(df: DataFrame, k: int = MISMATCH_ROWS) -> DataFrame:
    """The first ``k`` mismatches of each kind, in row order.  The rank filter
    sits on the window, so Spark keeps only ``k`` rows per kind and task before
    the shuffle."""
    first = Window.partitionBy("mismatch_type").orderBy("row_id")
    ranked = df.filter("mismatch_flag").withColumn("position", F.row_number().over(first))
    return ranked.filter(F.col("position") <= k)


def top_categories(df: DataFrame, k: int = 10) -> DataFrame:
    return category_breakdown(df).limit(k)


def result_page(df: DataFrame, cap: int = PAGE_CAP) -> DataFrame:
    """The first ``cap`` rows by priority."""
    return by_priority(df).limit(cap)


def result_page_summary(df: DataFrame, cap: int = PAGE_CAP, mode: str | None = None) -> DataFrame:
    """The summary over the whole table that goes with a page."""
    summary = run_summary(df, mode)
    return summary.withColumn("rows_truncated", F.col("total") > cap)


def shape_for_export(df: DataFrame) -> DataFrame:
    """Booleans as 0/1 and nulls as empty text."""
    shaped = []
    for f in df.schema:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        kind = f.dataType.simpleString()
        if kind == "boolean":
            c = c.cast("int")
        if kind not in ("string",) and not kind.startswith(("array", "map", "struct")):
            c = c.cast("string")
        if not kind.startswith(("array", "map", "struct")):
            c = F.coalesce(c, F.lit(""))
        shaped.append(c.alias(f.name))
    return df.select(*shaped)


QUEUE_COLUMNS = {
    "review": ("text", "prediction", "confidence"),
    "mismatch": ("text", "prediction", "confidence", "mismatch_type"),
    "corrections": ("text", "prediction", "confidence", "human_label"),
}


def queue_rows(df: DataFrame, which: str, corrections: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """Rows of a work list: ``review``, ``mismatch`` (optionally one kind) or
    ``corrections``."""
    if which == "mismatch":
        rows = df.filter("mismatch_flag")
        rows = rows if kind is None else rows.filter(F.col("mismatch_type") == kind)
    else:
        rows = df.filter("needs_review")
        if which == "corrections":
            rows = review_decision(rows, corrections)
    return rows.select("row_id", *QUEUE_COLUMNS[which])
