"""Aggregates, entity findings and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import aggregates as A, caches, entities as N, evaluation as E
from ..operators import reshape as R
from ..sources import profile as P
from . import frames as T
from .registry import query

# Ratios are shown with nine digits on both sides, so that the order in which
# an engine adds doubles does not matter.
DIGITS = 9


def r9(column, name=None):
    return F.round(column, DIGITS).alias(name or column)


@query("label_distribution", f"""
WITH {T.FB} SELECT prediction, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM fb GROUP BY prediction""")
def label_distribution(spark, sf):
    return A.label_distribution(T.feedback(spark, sf), normalize=True).select("prediction", "n", r9("share"))


@query("label_stats", f"""
WITH {T.SCORED} SELECT prediction AS label, count(*) AS count, round(100 * count(*) / sum(count(*)) OVER (), 9) AS pct,
  round(avg(confidence), 9) AS avg_confidence, count(*) FILTER (is_minority_pattern) AS minority_count FROM scored GROUP BY prediction""")
def label_stats(spark, sf):
    stats = A.label_stats(T.scored(spark, sf), digits=False)
    return stats.select("label", "count", r9("pct"), r9("avg_confidence"), "minority_count")


@query("run_summary", f"""
WITH {T.SCORED} SELECT count(*) AS total, count(*) FILTER (is_minority_pattern) AS minority,
  round(100 * count(*) FILTER (is_minority_pattern) / count(*), 9) AS minority_pct,
  count(*) FILTER (needs_review) AS needs_review, round(100 * count(*) FILTER (needs_review) / count(*), 9) AS review_pct,
  count(*) FILTER (mismatch_flag) AS mismatch, round(100 * count(*) FILTER (mismatch_flag) / count(*), 9) AS mismatch_pct,
  round(avg(confidence), 9) AS avg_confidence, round(avg(priority_score), 9) AS avg_priority_score,
  count(DISTINCT prediction) AS labels,
  count(*) FILTER (catme_subtype = 'self_assessment') AS self_rows FROM scored""")
def run_summary(spark, sf):
    s = A.run_summary(T.scored(spark, sf), digits=False)
    return s.select(
        "total", "minority", r9("minority_pct"), "needs_review", r9("review_pct"), "mismatch",
        r9("mismatch_pct"), r9("avg_confidence"), r9("avg_priority_score"),
        F.size("label_distribution").cast("long").alias("labels"),
        F.col("catme_subtype_distribution")[C.SELF].alias("self_rows"),
    )


@query("run_summary_maps", f"""
WITH {T.SCORED}, cats AS (SELECT trim(unnest(string_split(minority_category, '|'))) AS k FROM scored WHERE is_minority_pattern)
SELECT 'label' AS map, prediction AS k, count(*) AS n FROM scored GROUP BY prediction
UNION ALL SELECT 'category', k, count(*) FROM cats WHERE k <> '' GROUP BY k
UNION ALL SELECT 'subtype', catme_subtype, count(*) FROM scored GROUP BY catme_subtype""")
def run_summary_maps(spark, sf):
    s = A.run_summary(T.scored(spark, sf))
    maps = {"label": "label_distribution", "category": "minority_category_breakdown", "subtype": "catme_subtype_distribution"}
    entries = F.array(*[F.struct(F.lit(k).alias("map"), F.col(c).alias("m")) for k, c in maps.items()])
    return s.select(F.explode(entries).alias("e")).select("e.map", F.explode("e.m").alias("k", "n"))


@query("category_breakdown", f"""
WITH {T.SCORED}, s AS (SELECT trim(unnest(string_split(minority_category, '|'))) AS category FROM scored WHERE is_minority_pattern)
SELECT category, count(*) AS n FROM s WHERE category <> '' GROUP BY category""")
def category_breakdown(spark, sf):
    return A.category_breakdown(T.scored(spark, sf))


@query("subtype_distribution", f"WITH {T.SCORED} SELECT catme_subtype, count(*) AS n FROM scored GROUP BY catme_subtype")
def subtype_distribution(spark, sf):
    return A.subtype_distribution(T.scored(spark, sf))


_CELLS = f"""{T.SCORED},
cells AS (SELECT entity, prediction AS label, count(*) AS n FROM scored GROUP BY ALL),
totals AS (SELECT entity, count(*) AS total, count(*) FILTER (is_minority_pattern) AS minority_count,
  avg(priority_score) AS avg_priority_score FROM scored GROUP BY entity),
findings AS (SELECT c.entity, c.label, c.n, 100 * c.n / t.total AS pct,
    label IN {T.in_sql(C.HIGH_TIER)} AS high FROM cells c JOIN totals t USING (entity)
  WHERE label IN {T.in_sql(C.HIGH_TIER + C.MEDIUM_TIER)} AND c.n >= 3 AND 100 * c.n / t.total >= 10),
top AS (SELECT entity, first(label ORDER BY high DESC, n DESC, label) AS label, count(*) AS k FROM findings GROUP BY entity)"""


@query("aggregate_by_entity", f"""
WITH {_CELLS}
SELECT t.entity, t.total AS total_responses, coalesce(p.label, '') AS top_negative_label, coalesce(p.k, 0) AS findings,
  p.k IS NOT NULL AS needs_attention, t.minority_count, round(t.avg_priority_score, 9) AS avg_priority_score,
  (SELECT count(*) FROM cells c WHERE c.entity = t.entity) AS labels
FROM totals t LEFT JOIN top p USING (entity)""")
def aggregate_by_entity(spark, sf):
    e = N.aggregate_by_entity(T.scored(spark, sf), "entity", digits=False)
    return e.select(
        "entity", "total_responses", "top_negative_label", F.size("flagged_findings").cast("long").alias("findings"),
        "needs_attention", "minority_count", r9("avg_priority_score"),
        F.size("label_counts").cast("long").alias("labels"),
    )


@query("entity_findings", f"WITH {_CELLS} SELECT entity, label, n AS count, round(pct, 9) AS pct FROM findings")
def entity_findings(spark, sf):
    e = N.aggregate_by_entity(T.scored(spark, sf), "entity", digits=False)
    rows = e.select("entity", F.explode("flagged_findings").alias("f"))
    return rows.select("entity", "f.label", "f.count", r9("f.pct", "pct"))


@query("summary_strings", f"""
WITH {_CELLS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, label) AS k FROM cells),
counts AS (SELECT entity, string_agg(label || ': ' || n, '; ' ORDER BY k) AS label_counts_str FROM ranked WHERE k <= 8 GROUP BY entity),
found AS (SELECT entity, string_agg(label || ' (' || n, '; ' ORDER BY n DESC, label) AS f FROM findings GROUP BY entity)
SELECT t.entity, c.label_counts_str, coalesce(f.f, '') AS findings_head FROM totals t JOIN counts c USING (entity) LEFT JOIN found f USING (entity)""")
def summary_strings(spark, sf):
    s = N.summary_strings(N.aggregate_by_entity(T.scored(spark, sf), "entity"))
    # Percentages are text here; they are compared as numbers in entity_findings.
    head = F.regexp_replace("flagged_findings_str", r" students, [0-9.]+%\)", "")
    return s.select("entity", "label_counts_str", head.alias("findings_head"))


@query("attention_summary", f"WITH {_CELLS} SELECT (SELECT count(*) FROM top) AS needing_attention, count(*) AS entities FROM totals")
def attention_summary(spark, sf):
    return N.attention_summary(N.aggregate_by_entity(T.scored(spark, sf), "entity"))


_MIXED = f"""{T.MERGED}, mixed AS (SELECT entity FROM merged GROUP BY entity
  HAVING bool_or(prediction IN {T.in_sql(C.DEPRIORITIZED_TIER)}) AND bool_or(prediction IN {T.in_sql(C.HIGH_TIER + C.MEDIUM_TIER)}))"""


@query("mixed_signals", f"""
WITH {_MIXED}, m AS (SELECT *, entity IN (SELECT entity FROM mixed) AND prediction IN {T.in_sql(C.HIGH_TIER + C.MEDIUM_TIER)} AS hit FROM merged)
SELECT row_id, is_minority_pattern OR hit AS is_minority_pattern,
  CASE WHEN NOT hit THEN minority_category WHEN minority_category IN ('', 'Statistical_Outlier_Only') THEN 'Mixed_Signal_Pattern'
    ELSE 'Mixed_Signal_Pattern|' || minority_category END AS minority_category FROM m""")
def mixed_signals(spark, sf):
    from ..operators.signals import merge_minority_flags

    rows = N.mixed_signals(merge_minority_flags(T.unmerged(spark, sf)), "entity")
    return rows.select("row_id", "is_minority_pattern", "minority_category")


@query("label_overlap", f"""
WITH {T.FB} SELECT entity, bool_or(prediction IN {T.in_sql(C.DEPRIORITIZED_TIER)}) AS has_positive,
  bool_or(prediction IN {T.in_sql(C.HIGH_TIER + C.MEDIUM_TIER)}) AS has_actionable FROM fb GROUP BY entity""")
def label_overlap(spark, sf):
    return N.label_overlap(T.feedback(spark, sf), "entity")


@query("minority_job_summary", f"""
WITH {T.SCORED} SELECT count(*) AS total, count(*) FILTER (is_minority_pattern) AS flagged FROM scored""")
def minority_job_summary(spark, sf):
    return A.minority_job_summary(T.scored(spark, sf)).drop("pct")


@query("success_criteria_course", f"""
WITH {T.SCORED}, m AS (SELECT 100 * avg((prediction IN {T.in_sql(A.COURSE_MAJORITY)})::INT) AS p, count(DISTINCT prediction) AS k,
  count(*) FILTER ({T.REAL}) AS r FROM scored)
SELECT round(p, 9) AS majority_positive_pct, k AS n_label_categories, r AS real_minority_count,
  p < 30 AS pass_majority_pct, k >= 8 AS pass_label_spread, r > 0 AS pass_minority_count FROM m""")
def success_criteria_course(spark, sf):
    s = A.success_criteria(T.scored(spark, sf), C.S2P)
    return s.withColumn("majority_positive_pct", F.round("majority_positive_pct", DIGITS))


@query("success_criteria_peer", f"""
WITH {T.SCORED}, m AS (SELECT 100 * avg((prediction = 'Majority_Positive')::INT) AS p,
  count(*) FILTER (starts_with(prediction, 'Negative_')) AS k, count(*) FILTER ({T.REAL}) AS r FROM scored)
SELECT round(p, 9) AS majority_positive_pct, k AS negative_labeled_count, r AS real_minority_count,
  p < 30 AS pass_majority_pct, k >= 3000 AS pass_negative_count, r >= 500 AS pass_minority_count FROM m""")
def success_criteria_peer(spark, sf):
    s = A.success_criteria(T.scored(spark, sf), C.S2S)
    return s.withColumn("majority_positive_pct", F.round("majority_positive_pct", DIGITS))


@query("imbalance_check", """
SELECT o_orderstatus AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM orders
GROUP BY o_orderstatus QUALIFY count(*) / sum(count(*)) OVER () > 0.30""")
def imbalance_check(spark, sf):
    rows = T.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("label"))
    return A.imbalance_check(rows).select("label", "n", r9("share"))


@query("class_weights", f"""
WITH {T.JUDGED}, c AS (SELECT label, count(*) AS n FROM judged GROUP BY label),
b AS (SELECT *, n < max(n) OVER () AND label NOT IN ('Majority_Positive', 'Self_Positive') AS boosted,
  sum(n) OVER () / (count(*) OVER () * n) AS w FROM c)
SELECT label, n, boosted, round(CASE WHEN boosted THEN w * 3 ELSE w END, 9) AS weight FROM b""")
def class_weights(spark, sf):
    return E.class_weights(T.judged(spark, sf)).select("label", "n", "boosted", r9("weight"))


_METRICS = f"""{T.JUDGED}, names AS (SELECT label FROM judged UNION SELECT prediction FROM judged),
m AS (SELECT label, (SELECT count(*) FROM judged j WHERE j.label = n.label) AS support,
  (SELECT count(*) FROM judged j WHERE j.prediction = n.label) AS guessed,
  (SELECT count(*) FROM judged j WHERE j.label = n.label AND j.prediction = n.label) AS hits FROM names n),
r AS (SELECT label, support, CASE WHEN guessed > 0 THEN hits / guessed ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall, 2 * hits / (guessed + support) AS f1 FROM m)"""


@query("classification_report", f"""
WITH {_METRICS}, u AS (SELECT label, precision, recall, f1, support FROM r
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) FROM r)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support FROM u""")
def classification_report(spark, sf):
    rows = E.classification_report(T.judged(spark, sf))
    return rows.select("label", r9("precision"), r9("recall"), r9("f1"), "support")


@query("confusion_matrix", f"WITH {T.JUDGED} SELECT label AS truth, prediction AS predicted, count(*) AS n FROM judged GROUP BY ALL")
def confusion_matrix(spark, sf):
    return E.confusion_matrix(T.judged(spark, sf))


@query("minority_f1_mean", f"""
WITH {_METRICS}, top AS (SELECT max(support) AS s FROM r)
SELECT round(coalesce(avg(f1), 0), 9) AS minority_f1_mean FROM r, top
WHERE support > 0 AND support < s AND label NOT IN ('Majority_Positive', 'Self_Positive')""")
def minority_f1_mean(spark, sf):
    rows = T.judged(spark, sf)
    boosted = E.class_weights(rows).filter("boosted").select("label")
    return E.minority_f1_mean(rows, boosted).select(r9("minority_f1_mean"))


@query("distinct_texts", "SELECT sha256(text) AS text_hash, min(doc_id) AS row_id FROM documents GROUP BY text")
def distinct_texts(spark, sf):
    return caches.distinct_texts(T.feedback(spark, sf)).select("text_hash", "row_id")


@query("confidence_histogram", f"""
WITH {T.FB} SELECT CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'mid' ELSE 'low' END AS band, count(*) AS n FROM fb GROUP BY 1""")
def confidence_histogram(spark, sf):
    return A.confidence_histogram(T.feedback(spark, sf))


@query("minority_kpis", f"""
WITH {T.SCORED} SELECT count(*) AS total, count(*) FILTER (is_minority_pattern) AS flagged,
  round(100 * count(*) FILTER (is_minority_pattern) / count(*), 9) AS pct,
  count(*) FILTER (is_outlier) AS outliers, count(*) FILTER (is_minority_cluster) AS small_clusters FROM scored""")
def minority_kpis(spark, sf):
    return A.minority_kpis(T.scored(spark, sf)).withColumn("pct", F.round("pct", DIGITS))


@query("category_shares", f"""
WITH {T.SCORED}, s AS (SELECT trim(unnest(string_split(minority_category, '|'))) AS category FROM scored WHERE is_minority_pattern),
f AS (SELECT count(*) AS flagged FROM scored WHERE is_minority_pattern)
SELECT category, count(*) AS n, any_value(flagged) AS flagged, round(100 * count(*) / any_value(flagged), 9) AS pct
FROM s, f WHERE category <> '' GROUP BY category""")
def category_shares(spark, sf):
    return A.category_shares(T.scored(spark, sf)).withColumn("pct", F.round("pct", DIGITS))


@query("prediction_summary", f"""
WITH {T.JUDGED} SELECT count(*) AS total, round(avg(confidence), 9) AS avg_confidence, count(DISTINCT prediction) AS labels FROM judged""")
def prediction_summary(spark, sf):
    s = A.prediction_summary(T.judged(spark, sf))
    return s.select("total", r9("avg_confidence"), F.size("label_distribution").cast("long").alias("labels"))


@query("label_universe", f"WITH {T.JUDGED} SELECT label FROM judged UNION SELECT prediction FROM judged")
def label_universe(spark, sf):
    return E.label_universe(T.judged(spark, sf))


@query("label_group_totals", f"""
WITH {T.PEER}, s AS (SELECT prediction AS label, count(*) AS n FROM peer GROUP BY 1),
g AS (SELECT unnest(['Positive', 'Negative', 'Minority', 'Suggestion', 'Self']) AS label_group)
SELECT label_group, sum(n)::BIGINT AS total FROM s JOIN g ON contains(lower(label), lower(label_group)) GROUP BY 1""")
def label_group_totals(spark, sf):
    stats = A.label_distribution(T.peer(spark, sf)).select(F.col("prediction").alias("label"), F.col("n").alias("count"))
    return A.label_group_totals(stats)


@query("profile_columns", """
SELECT 'text' AS "column", count(text) AS non_null, count(try_cast(text AS DOUBLE)) AS numbers, round(avg(length(text)), 9) AS mean_length,
  min(try_cast(text AS DOUBLE)) AS low, max(try_cast(text AS DOUBLE)) AS high FROM documents
UNION ALL SELECT 'lang', count(lang), 0, round(avg(length(lang)), 9), NULL, NULL FROM documents
UNION ALL SELECT 'source', count(source), 0, round(avg(length(source)), 9), NULL, NULL FROM documents
UNION ALL SELECT 'n_chars', count(n_chars), count(n_chars), round(avg(length(n_chars::VARCHAR)), 9), min(n_chars), max(n_chars) FROM documents""")
def profile_columns(spark, sf):
    rows = T.table(spark, sf, "documents").select("text", "lang", "source", "n_chars")
    return P.profile_table(rows).select("column", "non_null", "numbers", r9("mean_length"), "low", "high")


_LENGTHS = " UNION ALL ".join(
    f"SELECT '{c}' AS name, avg(length({c})) AS m, {80 * (c == 'text')} AS bonus FROM fb" for c in ("text", "entity", "prediction")
)
_RANGES = " UNION ALL ".join(
    f"SELECT {i} AS k, '{c}' AS name, min({c}) AS low, max({c}) AS high FROM fb" for i, c in enumerate(("row_id", "rating", "confidence"))
)


@query("detect_columns", f"""
WITH {T.FB}, lengths AS ({_LENGTHS}), ranges AS ({_RANGES})
SELECT 'text' AS role, row_number() OVER (ORDER BY m + bonus DESC) AS position, name FROM lengths WHERE m >= 10
UNION ALL SELECT 'rating', 1, first(name ORDER BY k) FROM ranges WHERE low >= 1 AND high <= 10""")
def detect_columns(spark, sf):
    profile = P.profile_columns(T.feedback(spark, sf))
    names = P.detect_text_columns(profile)
    found = [("text", i + 1, c) for i, c in enumerate(names)]
    found += [("rating", 1, P.detect_rating_column(profile, names))]
    label = P.detect_label_column(profile, names)
    found += [("label", 1, label)] if label else []
    return spark.createDataFrame(found, "role string, position long, name string")


@query("detect_rating_text_pairs", f"""
WITH {T.WIDE}, f AS (SELECT bool_and(teaching IN (-1, 0, 1)) AS a, bool_and(labwork IN (-1, 0, 1)) AS b FROM wide)
SELECT 'teaching' AS rating, 'teaching_text' AS text, 'teaching' AS dimension FROM f WHERE a AND b
UNION ALL SELECT 'labwork', 'labwork_text', 'labwork' FROM f WHERE a AND b""")
def detect_rating_text_pairs(spark, sf):
    pairs = P.detect_rating_text_pairs(P.profile_columns(T.wide_course(spark, sf)))
    return spark.createDataFrame(pairs, "rating string, text string, dimension string")


def _entity(df):
    return R.summary_entity_column(df.columns)


@query("resolve_entity_column", f"""
WITH {T.FB} SELECT 'name' AS entity_column, entity AS name, count(*) AS n FROM fb GROUP BY entity""")
def resolve_entity_column(spark, sf):
    rows = T.feedback(spark, sf).withColumnRenamed("entity", "name").withColumn("dimension", F.lit("overall"))
    found = _entity(rows)
    return rows.groupBy(F.lit(found).alias("entity_column"), F.col(found)).agg(F.count("*").alias("n"))
