"""Read side: top-k lists, browsing, review and export rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..operators import aggregates as A, entities as N, views as V
from ..session import scratch_folder
from ..sources import files, runs, sinks
from . import frames as T
from .aggregates import _CELLS, r9
from .registry import query


@query("by_priority", f"WITH {T.SCORED} SELECT row_id, priority_score FROM scored ORDER BY priority_score DESC, row_id")
def by_priority(spark, sf):
    return V.by_priority(T.scored(spark, sf)).select("row_id", "priority_score")


@query("priority_alerts", f"WITH {T.SCORED} SELECT row_id, priority_score FROM scored ORDER BY priority_score DESC, row_id LIMIT 100")
def priority_alerts(spark, sf):
    return V.priority_alerts(T.scored(spark, sf)).select("row_id", "priority_score")


@query("browse", f"""
WITH {T.SCORED} SELECT row_id, prediction, confidence FROM scored WHERE contains(lower(text), 'the') AND is_minority_pattern
ORDER BY confidence DESC, row_id LIMIT 50 OFFSET 50""")
def browse(spark, sf):
    page = V.browse(T.scored(spark, sf), search="THE", minority=True, page=1)
    return page.select("row_id", "prediction", "confidence")


@query("browse_by_label", f"""
WITH {T.SCORED} SELECT row_id, mismatch_flag FROM scored WHERE prediction = 'Lab_Positive' ORDER BY mismatch_flag, row_id LIMIT 50""")
def browse_by_label(spark, sf):
    page = V.browse(T.scored(spark, sf), label="Lab_Positive", sort_key="mismatch_flag", asc=True)
    return page.select("row_id", "mismatch_flag")


@query("browse_labels", f"""
WITH {T.SCORED} SELECT prediction AS label, count(*) AS count, round(avg(confidence), 9) AS avg_confidence FROM scored
WHERE contains(lower(prediction), 'negative') GROUP BY 1 ORDER BY avg_confidence DESC""")
def browse_labels(spark, sf):
    stats = A.label_stats(T.scored(spark, sf), digits=False)
    return V.browse_labels(stats, "NEGATIVE", "confidence").select("label", "count", r9("avg_confidence"))


@query("search_minority", f"""
WITH {T.SCORED} SELECT row_id, minority_category FROM scored WHERE is_minority_pattern
  AND (contains(lower(text), 'outlier') OR contains(lower(minority_category), 'outlier')) ORDER BY row_id LIMIT 100""")
def search_minority(spark, sf):
    return V.search_minority(T.scored(spark, sf), "Outlier").select("row_id", "minority_category")


_REVIEW = f"""{T.SCORED}, {T.CORRECTIONS}, rq AS (SELECT s.row_id, s.text, s.prediction, s.confidence, decision,
  CASE decision WHEN 'approved' THEN prediction WHEN 'rejected' THEN 'REJECTED' ELSE '' END AS human_label
  FROM scored s LEFT JOIN corrections c USING (row_id) WHERE needs_review)"""


@query("review_queue", f"WITH {_REVIEW} SELECT row_id, human_label FROM rq WHERE decision = 'approved' ORDER BY row_id LIMIT 15 OFFSET 15")
def review_queue(spark, sf):
    page = V.review_queue(T.scored(spark, sf), T.corrections(spark, sf), "approved", page=1)
    return page.select("row_id", "human_label")


@query("review_progress", f"""
WITH {_REVIEW} SELECT count(*) AS total, count(decision) AS reviewed, count(*) FILTER (decision = 'approved') AS approved,
  count(*) FILTER (decision = 'rejected') AS rejected, count(*) FILTER (decision IS NULL) AS pending FROM rq""")
def review_progress(spark, sf):
    return V.review_progress(T.scored(spark, sf), T.corrections(spark, sf))


@query("mismatch_view", f"""
WITH {T.SCORED} SELECT row_id, mismatch_type, row_number() OVER (PARTITION BY mismatch_type ORDER BY row_id)::INT AS position
FROM scored WHERE mismatch_flag QUALIFY row_number() OVER (PARTITION BY mismatch_type ORDER BY row_id) <= 50""")
def mismatch_view(spark, sf):
    return V.mismatch_view(T.scored(spark, sf)).select("row_id", "mismatch_type", "position")


@query("top_categories", f"""
WITH {T.SCORED}, s AS (SELECT trim(unnest(string_split(minority_category, '|'))) AS category FROM scored WHERE is_minority_pattern)
SELECT category, count(*) AS n FROM s WHERE category <> '' GROUP BY 1 ORDER BY n DESC, category LIMIT 10""")
def top_categories(spark, sf):
    return V.top_categories(T.scored(spark, sf))


@query("top_entities", f"""
WITH {_CELLS} SELECT t.entity, coalesce(p.k, 0) AS findings FROM totals t LEFT JOIN top p USING (entity)
ORDER BY coalesce(p.k, 0) DESC, avg_priority_score DESC, t.entity LIMIT 8""")
def top_entities(spark, sf):
    top = N.top_entities(N.aggregate_by_entity(T.scored(spark, sf), "entity", digits=False))
    return top.select("entity", F.size("flagged_findings").cast("long").alias("findings"))


@query("result_page", f"WITH {T.SCORED} SELECT row_id, prediction FROM scored ORDER BY priority_score DESC, row_id LIMIT 10000")
def result_page(spark, sf):
    return V.result_page(T.scored(spark, sf)).select("row_id", "prediction")


@query("result_page_summary", f"WITH {T.SCORED} SELECT count(*) AS total, count(*) > 10000 AS rows_truncated FROM scored")
def result_page_summary(spark, sf):
    return V.result_page_summary(T.scored(spark, sf)).select("total", "rows_truncated")


@query("result_page_at_cap", f"""
WITH {T.SCORED}, page AS (SELECT row_id, prediction FROM scored ORDER BY priority_score DESC, row_id LIMIT 150)
SELECT row_id, prediction, (SELECT count(*) > 150 FROM scored) AS rows_truncated FROM page""")
def result_page_at_cap(spark, sf):
    rows = T.scored(spark, sf)
    truncated = V.result_page_summary(rows, 150).select("rows_truncated").scalar()
    return V.result_page(rows, 150).select("row_id", "prediction", truncated.alias("rows_truncated"))


@query("export_minority_rows", f"WITH {T.SCORED} SELECT row_id, minority_category FROM scored WHERE is_minority_pattern")
def export_minority_rows(spark, sf):
    return sinks.minority_rows(T.scored(spark, sf)).select("row_id", "minority_category")


_PEER_SCORED = T.SCORED + f""", pl AS (SELECT doc_id AS row_id,
  {T.names_sql(C.PEER_LABELS + C.SELF_LABELS)}[((doc_id * doc_id + n_chars) % 11)::INT + 1] AS p FROM documents),
ps AS (SELECT scored.* REPLACE (p AS prediction) FROM scored JOIN pl USING (row_id))"""


@query("peer_split_rows", f"""
WITH {_PEER_SCORED}
SELECT 'priority_alerts' AS output, row_id FROM (SELECT row_id FROM ps ORDER BY priority_score DESC, row_id LIMIT 100)
UNION ALL SELECT 'minority_experiences', row_id FROM ps WHERE {T.REAL}
UNION ALL SELECT 'peer_feedback_results', row_id FROM ps WHERE catme_subtype = 'peer_feedback'
UNION ALL SELECT 'self_assessment_results', row_id FROM ps WHERE catme_subtype = 'self_assessment'
UNION ALL SELECT 'negative_peer_only', row_id FROM ps WHERE catme_subtype = 'peer_feedback' AND starts_with(prediction, 'Negative_')""")
def peer_split_rows(spark, sf):
    names = T.peer(spark, sf).select("row_id", F.col("prediction").alias("p"))
    rows = T.scored(spark, sf).join(names, "row_id").withColumn("prediction", F.col("p")).drop("p")
    return sinks.route(rows, sinks.peer_routes(rows)).select("output", "row_id")


@query("course_split_rows", f"""
WITH {T.SCORED}
SELECT 'priority_alerts' AS output, row_id FROM (SELECT row_id FROM scored ORDER BY priority_score DESC, row_id LIMIT 100)
UNION ALL SELECT 'minority_experiences', row_id FROM scored WHERE {T.REAL}
UNION ALL SELECT lower(split_part(prediction, '_', 1)) || '_results', row_id FROM scored
  WHERE split_part(prediction, '_', 1) IN {T.in_sql(sinks.COURSE_GROUPS)}""")
def course_split_rows(spark, sf):
    rows = T.scored(spark, sf)
    return sinks.route(rows, sinks.course_routes(rows)).select("output", "row_id")


@query("export_queue_review", f"WITH {_REVIEW} SELECT row_id, prediction, confidence FROM rq")
def export_queue_review(spark, sf):
    return V.queue_rows(T.scored(spark, sf), "review").drop("text")


@query("export_queue_mismatch", f"WITH {T.SCORED} SELECT row_id, prediction, confidence, mismatch_type FROM scored WHERE mismatch_flag")
def export_queue_mismatch(spark, sf):
    return V.queue_rows(T.scored(spark, sf), "mismatch").drop("text")


@query("export_queue_corrections", f"WITH {_REVIEW} SELECT row_id, prediction, confidence, human_label FROM rq")
def export_queue_corrections(spark, sf):
    return V.queue_rows(T.scored(spark, sf), "corrections", T.corrections(spark, sf)).drop("text")


@query("latest_runs", """
WITH log AS (SELECT o_custkey AS run_id, o_orderdate AS finished_at, o_orderkey, 'file' || o_orderkey || '.csv' AS filename,
  CASE WHEN o_orderstatus = 'F' THEN 'student_to_student' ELSE 'student_to_professor' END AS mode FROM orders),
newest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY finished_at DESC, filename DESC) = 1)
SELECT run_id, filename, mode FROM (SELECT * FROM newest ORDER BY finished_at DESC, run_id LIMIT 20) WHERE contains(mode, 'professor') OR contains(filename, 'professor')""")
def latest_runs(spark, sf):
    log = T.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderdate").alias("finished_at"),
        F.concat(F.lit("file"), "o_orderkey", F.lit(".csv")).alias("filename"),
        F.when(F.col("o_orderstatus") == "F", C.S2S).otherwise(C.S2P).alias("mode"),
    )
    return runs.latest_runs(log, search="PROFESSOR").select("run_id", "filename", "mode")


@query("export_report_row", f"""
WITH {T.SCORED} SELECT count(DISTINCT prediction)::INT AS label_count, count(*) AS total, count(*) FILTER (is_minority_pattern) AS minority FROM scored""")
def export_report_row(spark, sf):
    return sinks.report(T.scored(spark, sf), C.S2P).select("label_count", "summary.total", "summary.minority")


def _missing_as_null(column: str) -> str:
    return f"CASE WHEN {column} NOT IN {T.in_sql(files.MISSING)} THEN {column} END"


@query("csv_round_trip", f"""
WITH {T.FB} SELECT row_id, md5(replace({_missing_as_null('text')}, chr(13) || chr(10), chr(10))) AS text_md5, rating, prediction FROM fb""")
def csv_round_trip(spark, sf):
    """A full export, read back as a feedback file."""
    path = f"{scratch_folder(spark)}/exports/{uuid.uuid4().hex}"
    source = T.feedback(spark, sf).select(F.col("row_id").alias("id"), "text", "rating", "prediction")
    sinks.export_full(source, path)
    rows = files.read_feedback(spark, path)
    text = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    return rows.select(F.col("id").alias("row_id"), F.md5(text).alias("text_md5"), "rating", "prediction")


@query("read_by_own_header", f"""
WITH {T.FB} SELECT row_id, md5(replace({_missing_as_null('text')}, chr(13) || chr(10), chr(10))) AS text_md5, rating, prediction FROM fb""")
def read_by_own_header(spark, sf):
    """Every row in one of two folders whose files order and name their columns
    differently, read as one table."""
    path = f"{scratch_folder(spark)}/exports/{uuid.uuid4().hex}"
    source = T.feedback(spark, sf).select(F.col("row_id").alias("id"), "text", "rating", "prediction")
    rated = F.coalesce(F.col("rating") >= 3, F.lit(False))
    sinks.export_full(source.filter(rated), f"{path}/rated")
    sinks.export_full(source.filter(~rated).select("prediction", "rating", "text", "id"), f"{path}/others")
    rows = files.read_feedback(spark, f"{path}/*")
    text = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    return rows.select(F.col("id").alias("row_id"), F.md5(text).alias("text_md5"), "rating", "prediction")


@query("export_by_label", f"""
WITH {T.FB} SELECT prediction AS label, count(*) AS n FROM fb GROUP BY prediction""")
def export_by_label(spark, sf):
    """One folder per label, counted by the folder each row was read from."""
    path = f"{scratch_folder(spark)}/exports/{uuid.uuid4().hex}"
    sinks.export_by_label(T.feedback(spark, sf).select("row_id", "prediction", "confidence"), path)
    return spark.read.option("header", True).csv(path).groupBy("label").agg(F.count("*").alias("n"))
