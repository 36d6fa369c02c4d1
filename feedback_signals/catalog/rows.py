"""Row-wise operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import labels as L
from ..functions import scoring as S
from ..functions import text as X
from ..operators import labelling, reshape as R, signals as G, views as V
from . import frames as T
from .registry import query

TRIM = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
BODY = TRIM.format(c="text")


@query("combine_text", r"""
SELECT doc_id, trim(regexp_replace(lang || ' ' || coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, '') || ' ' || text,
  '\s+', ' ', 'g')) AS text FROM documents""")
def combine_text(spark, sf):
    rows = T.table(spark, sf, "documents").withColumn("source", F.expr("CASE WHEN doc_id % 2 = 0 THEN source END"))
    return R.combine_text(rows, ["lang", "source", "text"], force=True).select("doc_id", "text")


@query("drop_short", f"""
SELECT conv_id, turn, length(text) AS n FROM conversations WHERE length({BODY}) > 10""")
def drop_short(spark, sf):
    rows = R.drop_short(T.table(spark, sf, "conversations"), 10, strip=True)
    return rows.select("conv_id", "turn", F.length("text").cast("long").alias("n"))


# SQL word edges are ASCII there: accented letters get an ASCII mark first.
MASKED_NAMES = r"""regexp_replace(regexp_replace(regexp_replace(text, '([^\P{L}a-zA-Z])', '_\1_', 'g'),
  '\b[A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}\b', '[STUDENT]', 'g'), '_([^\P{L}a-zA-Z])_', '\1', 'g')"""


@query("anonymize", f"SELECT doc_id, {MASKED_NAMES} AS text FROM documents")
def anonymize(spark, sf):
    return R.anonymize(T.documents(spark, sf)).select("doc_id", "text")


@query("drop_noise", rf"""
SELECT doc_id, {BODY} AS text FROM documents
WHERE length({BODY}) >= 20 AND NOT regexp_matches({BODY}, '\b\d{{6,}}\b') AND regexp_matches({BODY}, '[a-zA-Z]{{3,}}')""")
def drop_noise(spark, sf):
    return R.drop_noise(T.documents(spark, sf)).select("doc_id", "text")


_SUBTYPE_HITS = " + ".join(f"contains(lower(text), '{p}')::INT" for p in T.SUBTYPE_PHRASES)


@query("feedback_subtype", rf"""
WITH h AS (SELECT conv_id, turn, {_SUBTYPE_HITS} AS hits,
  CASE WHEN {BODY} = '' THEN 0 ELSE len(regexp_split_to_array({BODY}, '\s+')) END AS words FROM conversations)
SELECT conv_id, turn, CASE WHEN hits >= 2 OR (hits = 1 AND words < 30) THEN 'self_assessment' ELSE 'peer_feedback' END AS subtype FROM h""")
def feedback_subtype(spark, sf):
    kind = X.feedback_subtype(F.col("text"), T.SUBTYPE_PHRASES)
    return T.table(spark, sf, "conversations").select("conv_id", "turn", kind.alias("subtype"))


@query("match_lexicon", f"""
WITH {T.FB}, k AS (SELECT row_id, {T.lexicon_sql('text')} AS c FROM fb)
SELECT row_id, c <> '' AS keyword_minority, CASE WHEN c = '' THEN 'Statistical_Outlier_Only' ELSE c END AS keyword_categories FROM k""")
def match_lexicon(spark, sf):
    rows = G.match_lexicon(T.feedback(spark, sf), T.LEXICON, none_label=C.OUTLIER_ONLY)
    return rows.select("row_id", "keyword_minority", "keyword_categories")


@query("match_large_lexicon", f"""
WITH {T.FB}, k AS (SELECT row_id, {T.categories_sql('text', T.LARGE_LEXICON)} AS c FROM fb)
SELECT row_id, c <> '' AS keyword_minority, c AS keyword_categories FROM k""")
def match_large_lexicon(spark, sf):
    return G.match_lexicon(T.feedback(spark, sf), T.LARGE_LEXICON).select("row_id", "keyword_minority", "keyword_categories")


@query("categorize_flagged", f"WITH {T.UNMERGED} SELECT row_id, minority_category FROM det")
def categorize_flagged(spark, sf):
    rows = G.categorize_flagged(T.detected(T.feedback(spark, sf)), T.LEXICON)
    return rows.select("row_id", "minority_category")


@query("rating_to_sentiment", f"""
WITH {T.FB} SELECT row_id, CASE WHEN rating < 2.5 THEN 'Negative' WHEN rating < 3.8 THEN 'Neutral'
  WHEN rating IS NOT NULL THEN 'Positive' END AS sentiment FROM fb""")
def rating_to_sentiment(spark, sf):
    return T.feedback(spark, sf).select("row_id", L.rating_to_sentiment(F.col("rating")).alias("sentiment"))


@query("rating_to_sentiment_quantile", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.33) AS a, quantile_cont(o_totalprice, 0.66) AS b FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 'Negative' WHEN o_totalprice <= b THEN 'Neutral'
  ELSE 'Positive' END AS sentiment FROM orders, q""")
def rating_to_sentiment_quantile(spark, sf):
    orders = T.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return labelling.quantile_labels(orders, "o_totalprice").select("o_orderkey", "sentiment")


@query("ternary_to_sentiment", f"""
WITH {T.WIDE} SELECT row_id, CASE WHEN teaching < 0 THEN 'Negative' WHEN teaching = 0 THEN 'Neutral' ELSE 'Positive' END AS sentiment FROM wide""")
def ternary_to_sentiment(spark, sf):
    return T.wide_course(spark, sf).select("row_id", L.ternary_to_sentiment(F.col("teaching")).alias("sentiment"))


@query("derive_labels", f"""
WITH {T.FB} SELECT row_id, CASE WHEN rating < 2.5 THEN 'Negative' WHEN rating < 3.8 THEN 'Neutral'
  WHEN rating IS NOT NULL THEN 'Positive' END AS sentiment FROM fb""")
def derive_labels(spark, sf):
    return labelling.derive_labels(T.feedback(spark, sf), "no_such_column", "rating").select("row_id", "sentiment")


@query("derive_labels_by_source", f"""
WITH {T.FB}, {T.WIDE}
SELECT 'label' AS source, row_id, prediction AS sentiment FROM fb
UNION ALL SELECT 'ternary', row_id, CASE WHEN teaching < 0 THEN 'Negative' WHEN teaching = 0 THEN 'Neutral' ELSE 'Positive' END FROM wide
UNION ALL SELECT 'scorer', row_id, entity FROM fb""")
def derive_labels_by_source(spark, sf):
    """The other sources: a label column with white space, a -1/0/1 rating, a scorer."""
    rows = T.feedback(spark, sf)
    padded = rows.withColumn("given", F.concat(F.lit("  "), "prediction", F.lit("\n")))
    found = {
        "label": labelling.derive_labels(padded, "given", "rating"),
        "ternary": labelling.derive_labels(T.wide_course(spark, sf), None, "teaching", training=True),
        "scorer": labelling.derive_labels(rows, None, None, lambda df: df.withColumn("sentiment", F.col("entity"))),
    }
    parts = [df.select(F.lit(name).alias("source"), "row_id", "sentiment") for name, df in found.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("quality_to_rating", f"""
WITH {T.FB} SELECT row_id, CASE WHEN rating >= 4 THEN 1 WHEN rating >= 3 THEN 0 ELSE -1 END AS r FROM fb""")
def quality_to_rating(spark, sf):
    return T.feedback(spark, sf).select("row_id", L.quality_to_rating(F.col("rating")).alias("r"))


@query("rating_bucket", f"""
WITH {T.WIDE} SELECT row_id, CASE WHEN labwork > 0 THEN 'positive' WHEN labwork < 0 THEN 'negative' ELSE 'neutral' END AS bucket FROM wide""")
def rating_bucket(spark, sf):
    return T.wide_course(spark, sf).select("row_id", L.rating_bucket(F.col("labwork")).alias("bucket"))


@query("seed_label", """
WITH w AS (SELECT doc_id, [' Awesome', 'good', 'AVERAGE ', 'poor', 'awful', 'other'][(doc_id % 6)::INT + 1] AS word FROM documents)
SELECT doc_id, CASE lower(trim(word)) WHEN 'awesome' THEN 'Teaching_Positive_Engagement' WHEN 'good' THEN 'Teaching_Positive_Clarity'
  WHEN 'average' THEN 'Majority_Positive' WHEN 'poor' THEN 'Teaching_Negative_Clarity' WHEN 'awful' THEN 'Teaching_Negative_Clarity' END AS label FROM w""")
def seed_label(spark, sf):
    word = T.pick([" Awesome", "good", "AVERAGE ", "poor", "awful", "other"], F.col("doc_id") % 6)
    return T.table(spark, sf, "documents").select("doc_id", L.seed_label(word).alias("label"))


@query("broad_sentiment", f"WITH {T.PEER} SELECT row_id, {T.BROAD.format(c='prediction')} AS tone FROM peer")
def broad_sentiment(spark, sf):
    return T.peer(spark, sf).select("row_id", L.broad_sentiment(F.col("prediction")).alias("tone"))


@query("coarse_polarity", f"""
WITH {T.PEER} SELECT row_id, CASE WHEN prediction ILIKE 'positive%' THEN 'Positive' WHEN prediction ILIKE 'negative%' THEN 'Negative'
  ELSE 'Neutral' END AS tone FROM peer""")
def coarse_polarity(spark, sf):
    return T.peer(spark, sf).select("row_id", L.coarse_polarity(F.col("prediction")).alias("tone"))


@query("detect_mismatch", f"WITH {T.FB} SELECT row_id, {T.MISMATCH} <> '' AS mismatch_flag, {T.MISMATCH} AS mismatch_type FROM fb")
def detect_mismatch(spark, sf):
    return G.detect_mismatch(T.feedback(spark, sf)).select("row_id", "mismatch_flag", "mismatch_type")


@query("detect_mismatch_prefix", f"""
WITH {T.PEER}, p AS (SELECT *, CASE WHEN prediction ILIKE 'positive%' THEN 'Positive' WHEN prediction ILIKE 'negative%' THEN 'Negative'
  ELSE 'Neutral' END AS tone FROM peer)
SELECT row_id, CASE WHEN rating >= 3.8 AND tone <> 'Positive' THEN 'HIGH_MISMATCH'
  WHEN rating <= 2.5 AND tone = 'Positive' THEN 'REVERSE_MISMATCH' ELSE '' END AS mismatch_type FROM p""")
def detect_mismatch_prefix(spark, sf):
    return G.detect_mismatch(T.peer(spark, sf), polarity="prefix").select("row_id", "mismatch_type")


@query("flag_review", f"WITH {T.FB} SELECT row_id, confidence < 0.65 AS needs_review, round(confidence, 4) AS confidence FROM fb")
def flag_review(spark, sf):
    return G.flag_review(T.feedback(spark, sf)).select("row_id", "needs_review", "confidence")


@query("merge_minority_flags", f"WITH {T.MERGED} SELECT row_id, is_minority_pattern, minority_category FROM merged")
def merge_minority_flags(spark, sf):
    return G.merge_minority_flags(T.unmerged(spark, sf)).select("row_id", "is_minority_pattern", "minority_category")


@query("suppress_positive_outliers", f"""
WITH {T.MERGED}, s AS (SELECT *, NOT keyword_minority AND contains(minority_category, 'Statistical_Outlier_Only')
  AND prediction IN {T.in_sql(C.DEPRIORITIZED_TIER)} AS gone FROM merged)
SELECT row_id, is_minority_pattern AND NOT gone AS is_minority_pattern,
  CASE WHEN gone THEN '' ELSE minority_category END AS minority_category FROM s""")
def suppress_positive_outliers(spark, sf):
    rows = G.suppress_positive_outliers(G.merge_minority_flags(T.unmerged(spark, sf)))
    return rows.select("row_id", "is_minority_pattern", "minority_category")


@query("priority_score", f"WITH {T.MERGED} SELECT row_id, {T.priority_sql(T.REAL)} AS priority_score FROM merged")
def priority_score(spark, sf):
    rows = G.add_priority(G.merge_minority_flags(T.unmerged(spark, sf)))
    return rows.select("row_id", "priority_score")


@query("is_real_minority", f"WITH {T.MERGED} SELECT row_id, minority_category FROM merged WHERE {T.REAL} AND minority_category <> ''")
def is_real_minority(spark, sf):
    rows = G.merge_minority_flags(T.unmerged(spark, sf))
    return G.real_minority(rows, require_nonempty=True).select("row_id", "minority_category")


@query("confidence_band", f"""
WITH {T.FB} SELECT row_id, CASE WHEN confidence >= 0.8 THEN 'green' WHEN confidence >= 0.65 THEN 'amber' ELSE 'red' END AS band FROM fb""")
def confidence_band(spark, sf):
    band = S.confidence_band(F.col("confidence"), (0.8, 0.65), ("green", "amber", "red"))
    return T.feedback(spark, sf).select("row_id", band.alias("band"))


@query("label_family", f"""
WITH {T.PEER}, l AS (SELECT row_id, lower(prediction) AS p FROM peer)
SELECT row_id, CASE WHEN contains(p, 'positive') THEN 'positive' WHEN contains(p, 'negative') THEN 'negative'
  WHEN contains(p, 'minority') THEN 'minority' WHEN contains(p, 'suggestion') THEN 'suggestion' ELSE 'other' END AS family FROM l""")
def label_family(spark, sf):
    return T.peer(spark, sf).select("row_id", L.label_family(F.col("prediction")).alias("family"))


@query("text_key", "SELECT doc_id, substr(sha256(text), 1, 16) AS key FROM documents")
def text_key(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", X.text_key(F.col("text")).alias("key"))


@query("shape_for_export", f"""
WITH {T.FB} SELECT row_id::VARCHAR AS row_id, CASE WHEN row_id % 2 = 0 THEN '1' ELSE '0' END AS flag,
  coalesce(CASE WHEN rating IS NOT NULL THEN prediction END, '') AS label FROM fb""")
def shape_for_export(spark, sf):
    rows = T.feedback(spark, sf).select(
        "row_id", (F.col("row_id") % 2 == 0).alias("flag"),
        F.when(F.col("rating").isNotNull(), F.col("prediction")).alias("label"),
    )
    return V.shape_for_export(rows)


@query("review_decision", f"""
WITH {T.SCORED}, {T.CORRECTIONS}
SELECT s.row_id, CASE decision WHEN 'approved' THEN prediction WHEN 'rejected' THEN 'REJECTED' ELSE '' END AS human_label
FROM scored s LEFT JOIN corrections c USING (row_id)""")
def review_decision(spark, sf):
    rows = V.review_decision(T.scored(spark, sf), T.corrections(spark, sf))
    return rows.select("row_id", "human_label")


@query("melt_dimensions", rf"""
WITH {T.WIDE}, u AS (SELECT row_id, entity, teaching AS rating, teaching_text AS text, 'teaching' AS dimension FROM wide
  UNION ALL SELECT row_id, entity, labwork, labwork_text, 'labwork' FROM wide)
SELECT row_id, entity, rating::DOUBLE AS rating, text, dimension FROM u WHERE length({BODY}) > 5""")
def melt_dimensions(spark, sf):
    return R.melt_dimensions(T.wide_course(spark, sf), T.WIDE_PAIRS, keep=("row_id", "entity"))


@query("split_categories", f"""
WITH {T.MERGED}, s AS (SELECT row_id, trim(unnest(string_split(minority_category, '|'))) AS category FROM merged)
SELECT row_id, category FROM s WHERE category <> ''""")
def split_categories(spark, sf):
    rows = G.merge_minority_flags(T.unmerged(spark, sf))
    return R.split_categories(rows).select("row_id", "category")


def _signal_sql(words) -> str:
    return " + ".join(f"contains(t, '{w}')::INT" for w in words)


@query("detect_feedback_mode", f"""
WITH {T.FB}, j AS (SELECT lower(string_agg(text, ' ' ORDER BY row_id)) AS t FROM fb),
s AS (SELECT {_signal_sql(T.PEER_WORDS)} AS peer_score, {_signal_sql(T.PROFESSOR_WORDS)} AS professor_score FROM j)
SELECT peer_score, professor_score, CASE WHEN peer_score >= professor_score THEN 'student_to_student'
  ELSE 'student_to_professor' END AS feedback_mode FROM s""")
def detect_feedback_mode(spark, sf):
    return R.detect_feedback_mode(T.feedback(spark, sf), peer=T.PEER_WORDS, professor=T.PROFESSOR_WORDS)
