"""Writing results.  Every sink is a distributed write into a folder."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import config as C
from ..functions.scoring import is_real_minority
from ..operators.aggregates import prediction_summary, run_summary
from ..operators.entities import aggregate_by_entity, by_attention, summary_strings
from ..operators.evaluation import classification_report
from ..operators.views import is_priority_alert, queue_rows, shape_for_export

# Label groups of the course-evaluation outputs.
COURSE_GROUPS = ("Teaching", "Content", "Exam", "Lab", "Support")


def write_csv(df: DataFrame, path: str, quote_all: bool = False, by: str | None = None) -> None:
    """Quotes inside a cell are doubled, so any CSV reader gets them back.  Rows stand
    in a folder for each value of the column ``by``."""
    flat = shape_for_export(df)
    for f in flat.schema:
        if f.dataType.simpleString().startswith(("array", "map", "struct")):
            flat = flat.withColumn(f.name, F.to_json(f.name))
    flat.write.mode("overwrite").partitionBy(*([by] if by else [])).options(
        header=True, escape='"', quoteAll=quote_all, emptyValue="" if not quote_all else '""',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def folder_column(df: DataFrame, name: str) -> str:
    """``name``, or ``name_1`` and so on where the rows have that column."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n not in taken)


def save_scored(df: DataFrame, path: str, run_id: str) -> None:
    """The scored table of a run; rerunning a run replaces only that run."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def export_full(df: DataFrame, path: str) -> None:
    write_csv(df, path)


def minority_rows(df: DataFrame) -> DataFrame:
    return df.filter("is_minority_pattern")


def export_minority(df: DataFrame, path: str) -> None:
    write_csv(minority_rows(df), path)


def safe_name(label):
    return F.translate(label, "/ ", "__")


def export_by_label(df: DataFrame, path: str, label: str | None = None) -> None:
    """One folder per label in a single write, or one known label.  The folders are
    named ``label=...``, or ``label_1=...`` and so on where the rows have that column."""
    if label is not None:
        rows = df.filter(F.col("prediction") == label)
        if rows.isEmpty():
            raise ValueError(f"label {label!r} does not occur")
        write_csv(rows, path)
        return
    folder = folder_column(df, "label")
    labelled = df.filter(F.col("prediction").isNotNull())
    write_csv(labelled.withColumn(folder, safe_name(F.col("prediction"))), path, by=folder)


def peer_routes(df: DataFrame) -> dict[str, Column]:
    """The outputs of a peer-feedback run, each the condition on its rows."""
    is_peer = F.col("catme_subtype") == C.PEER if "catme_subtype" in df.columns else F.lit(True)
    is_self = F.col("catme_subtype") == C.SELF if "catme_subtype" in df.columns else F.lit(False)
    return {
        **_common_routes(df),
        "peer_feedback_results": is_peer,
        "self_assessment_results": is_self,
        "negative_peer_only": is_peer & F.startswith(F.col("prediction"), F.lit("Negative_")),
    }


def course_routes(df: DataFrame) -> dict[str, Column]:
    """The row outputs of a course-evaluation run, each the condition on its rows."""
    in_group = lambda group: F.startswith(F.col("prediction"), F.lit(group + "_"))
    return {**_common_routes(df), **{f"{g.lower()}_results": in_group(g) for g in COURSE_GROUPS}}


def _common_routes(df: DataFrame) -> dict[str, Column]:
    return {
        "priority_alerts": is_priority_alert(df),
        "minority_experiences": is_real_minority(F.col("is_minority_pattern"), F.col("minority_category")),
    }


def route(df: DataFrame, routes: Mapping[str, Column], output: str = "output") -> DataFrame:
    """Every row once for each output that it belongs to, named in ``output``.  One
    scan serves any number of outputs; a row that belongs to none is left out."""
    names = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in routes.items()]))
    return df.withColumn(output, names).withColumn(output, F.explode(output))


def entity_summary(df: DataFrame, entity: str | None = None, settings: C.Settings = C.DEFAULTS) -> DataFrame:
    return summary_strings(by_attention(aggregate_by_entity(df, entity, settings)))


def export_split(df: DataFrame, folder: str, mode: str, entity: str | None = None) -> list[str]:
    """Write the outputs of ``mode`` and return their names.  ``df`` should be a stored
    table (see ``save_scored``).

    One scan and one write serve all outputs of rows, each in ``rows/output=<name>``
    (``output_1`` and so on where the rows have that column); one without rows has no
    folder, ``read_output`` reads it as empty.  Two passes over a few columns find the
    last priority alert and, for courses, the table ``dimension_summary``.
    """
    routes = peer_routes(df) if mode == C.S2S else course_routes(df)
    output = folder_column(df, "output")
    write_csv(route(df, routes, output), f"{folder}/rows", by=output)
    if mode == C.S2S:
        return list(routes)
    write_csv(entity_summary(df, entity), f"{folder}/dimension_summary")
    return [*routes, "dimension_summary"]


def read_output(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows that ``export_split`` wrote for an output, every column as text and
    named as in the exported ``df``.  Only the files of that output are read."""
    output = folder_column(df, "output")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*df.columns, output)])
    rows = df.sparkSession.read.schema(schema).options(header=True, escape='"', multiLine=True).csv(f"{folder}/rows")
    return rows.filter(F.col(output) == name).drop(output)


def export_peer_split(df: DataFrame, folder: str) -> list[str]:
    return export_split(df, folder, C.S2S)


def export_course_split(df: DataFrame, folder: str, entity: str | None = None) -> list[str]:
    return export_split(df, folder, C.S2P, entity)


def export_queue(df: DataFrame, path: str, which: str, corrections: DataFrame | None = None, kind: str | None = None) -> None:
    write_csv(queue_rows(df, which, corrections, kind).drop("row_id"), path, quote_all=True)


def report(df: DataFrame, mode: str | None = None) -> DataFrame:
    """One JSON-ready row: the summary and its maps."""
    summary = run_summary(df, mode)
    maps = ("label_distribution", "minority_category_breakdown", "catme_subtype_distribution")
    plain = [c for c in summary.columns if c not in maps]
    return summary.select(
        F.current_timestamp().alias("generated_at"),
        F.struct(*plain).alias("summary"),
        "label_distribution",
        F.col("minority_category_breakdown").alias("minority_categories"),
        F.col("catme_subtype_distribution").alias("catme_subtypes"),
        F.size("label_distribution").alias("label_count"),
    )


def export_report(df: DataFrame, path: str, mode: str | None = None) -> None:
    report(df, mode).coalesce(1).write.mode("overwrite").json(path)


def save_metrics(evaluated: DataFrame, path: str) -> None:
    """Summary, averages and per-label scores of an evaluation, as JSON."""
    rows = classification_report(evaluated)
    entries = F.map_from_entries(F.collect_list(F.struct(
        "label", F.struct("precision", "recall", "f1", "support")
    )))
    summary = prediction_summary(evaluated)
    summary.withColumn("labels", rows.agg(entries).scalar()).coalesce(1).write.mode("overwrite").json(path)

