"""The driver's tables seen as feedback tables, in Spark and in SQL.

``documents`` stand for feedback: labels, ratings and confidences follow from
the document id and length, in the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as C
from ..operators import signals as G
from ..session import spread_small

# Phrases that do occur in the documents.
LEXICON = {
    "Insult": ["idiot", "moron", "stupid", "worthless", "trash"],
    "Licence": ["apache license", "general public license"],
    "Frequent": ["that", "with", "this"],
}
SUBTYPE_PHRASES = ("que ", " the ", " de ", "tion", "ung")
PEER_WORDS = ("the", "that", "zzz")
PROFESSOR_WORDS = ("une", "der", "license", "el ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names, number):
    return F.element_at(F.array(*map(F.lit, names)), (number + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_small(table(spark, sf_dir, "documents"), "doc_id")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return documents(spark, sf_dir).select(
        d.alias("row_id"),
        "text",
        F.concat_ws("/", "source", "lang").alias("entity"),
        F.when(d % 13 != 0, 1 + (F.col("n_chars") % 9) * 0.5).alias("rating"),
        pick(C.PROFESSOR_LABELS, (d * d + F.col("n_chars")) % 24).alias("prediction"),
        (((d * 37 + F.col("n_chars")) % 101) / 100.0).alias("confidence"),
    )


def peer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with peer and self labels."""
    d = F.col("doc_id")
    labels = C.PEER_LABELS + C.SELF_LABELS
    numbers = table(spark, sf_dir, "documents").select(
        d.alias("row_id"), pick(labels, (d * d + F.col("n_chars")) % 11).alias("prediction")
    )
    return feedback(spark, sf_dir).drop("prediction").join(numbers, "row_id")


def detected(df: DataFrame) -> DataFrame:
    """Detector columns as a function of the row id."""
    r = F.col("row_id")
    flagged = df.withColumns({
        "is_outlier": r % 12 == 0,
        "is_minority_cluster": r % 25 == 0,
        "is_noise": r % 7 == 0,
        "cluster_id": F.when(r % 7 == 0, -1).otherwise(r % 5),
    })
    return flagged.withColumn("is_minority_pattern", F.col("is_outlier") | F.col("is_minority_cluster"))


def unmerged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.match_lexicon(feedback(spark, sf_dir), LEXICON)
    return G.categorize_flagged(detected(rows), None)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored table: flags merged, review, priority, mismatch, subtype."""
    rows = G.merge_minority_flags(unmerged(spark, sf_dir))
    rows = rows.withColumn("needs_review", F.col("confidence") < 0.65)
    rows = G.detect_mismatch(G.add_priority(rows))
    kind = F.when(F.col("row_id") % 4 == 0, C.SELF).otherwise(C.PEER)
    return rows.withColumn("catme_subtype", kind)


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    decision = F.when(d % 3 == 0, "approved").otherwise("rejected")
    return table(spark, sf_dir, "labels").select(d.alias("row_id"), decision.alias("decision"))


def wide_course(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two (rating, text) column pairs per document."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("row_id"), F.concat_ws("/", "source", "lang").alias("entity"),
        (d % 3 - 1).alias("teaching"), F.col("text").alias("teaching_text"),
        (d % 5 % 3 - 1).alias("labwork"), F.concat_ws(" ", "lang", "source", "text").alias("labwork_text"),
    )


WIDE_PAIRS = [("teaching", "teaching_text", "teaching"), ("labwork", "labwork_text", "labwork")]


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a true label and a predicted one."""
    d = F.col("row_id")
    truth = pick(C.PEER_LABELS, (d * 7 + F.length("text")) % 7)
    guess = F.when(d % 3 == 0, pick(C.PEER_LABELS, (d + F.length("text")) % 7)).otherwise(truth)
    return feedback(spark, sf_dir).select("row_id", "text", "confidence", truth.alias("label"), guess.alias("prediction"))


# ------------------------------------------------------------------ SQL side
def names_sql(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def in_sql(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def any_sql(text: str, phrases) -> str:
    quoted = (p.replace("'", "''") for p in phrases)
    return "(" + " OR ".join(f"contains(lower({text}), '{p}')" for p in quoted) + ")"


def lexicon_sql(text: str) -> str:
    return "concat_ws('|', " + ", ".join(
        f"CASE WHEN {any_sql(text, ps)} THEN '{c}' END" for c, ps in LEXICON.items()
    ) + ")"


FB = f"""fb AS (
  SELECT doc_id AS row_id, text, source || '/' || lang AS entity,
    CASE WHEN doc_id % 13 <> 0 THEN 1::DOUBLE + (n_chars % 9) * 0.5::DOUBLE END AS rating,
    {names_sql(C.PROFESSOR_LABELS)}[((doc_id * doc_id + n_chars) % 24)::INT + 1] AS prediction,
    ((doc_id * 37 + n_chars) % 101)::DOUBLE / 100::DOUBLE AS confidence
  FROM documents)"""

PEER = FB + f""", peer AS (
  SELECT fb.* EXCLUDE (prediction),
    {names_sql(C.PEER_LABELS + C.SELF_LABELS)}[((doc_id * doc_id + n_chars) % 11)::INT + 1] AS prediction
  FROM fb JOIN documents d ON d.doc_id = fb.row_id)"""

UNMERGED = FB + f""", kw AS (
  SELECT *, {lexicon_sql('text')} AS keyword_categories FROM fb),
det AS (
  SELECT *, keyword_categories <> '' AS keyword_minority,
    row_id % 12 = 0 AS is_outlier, row_id % 25 = 0 AS is_minority_cluster,
    row_id % 7 = 0 AS is_noise,
    CASE WHEN row_id % 7 = 0 THEN -1 ELSE row_id % 5 END AS cluster_id,
    (row_id % 12 = 0 OR row_id % 25 = 0) AS is_minority_pattern,
    CASE WHEN NOT (row_id % 12 = 0 OR row_id % 25 = 0) THEN ''
         WHEN keyword_categories <> '' THEN keyword_categories
         ELSE 'Statistical_Outlier_Only' END AS minority_category
  FROM kw)"""

MERGED = UNMERGED + """, merged AS (
  SELECT * REPLACE (
    (is_minority_pattern OR keyword_minority) AS is_minority_pattern,
    (CASE WHEN keyword_minority THEN keyword_categories ELSE minority_category END) AS minority_category)
  FROM det)"""

REAL = "(is_minority_pattern AND NOT contains(coalesce(minority_category, ''), 'Statistical_Outlier_Only'))"
BROAD = """(CASE WHEN regexp_matches(lower({c}), '^(positive_|(teaching|content|exam|lab|support|majority|self)_positive)')
  THEN 'Positive' WHEN regexp_matches(lower({c}), '^(negative_|(teaching|content|exam|lab|support)_negative|self_struggle|self_minority)')
  THEN 'Negative' ELSE 'Neutral' END)"""


def priority_sql(real: str) -> str:
    return f"""least(10, (CASE WHEN {real} THEN 10 WHEN prediction IN {in_sql(C.HIGH_TIER)} THEN 9
      WHEN prediction IN {in_sql(C.MEDIUM_TIER)} THEN 7
      WHEN prediction IN {in_sql(C.DEPRIORITIZED_TIER)} THEN 1 ELSE 5 END)
      + (CASE WHEN confidence < 0.80 THEN 1 ELSE 0 END))"""


MISMATCH = f"""(CASE WHEN rating >= 3.8 AND {BROAD.format(c='prediction')} <> 'Positive' THEN 'HIGH_MISMATCH'
  WHEN rating <= 2.5 AND {BROAD.format(c='prediction')} = 'Positive' THEN 'REVERSE_MISMATCH' ELSE '' END)"""

SCORED = MERGED + f""", scored AS (
  SELECT *, confidence < 0.65 AS needs_review, {priority_sql(REAL)} AS priority_score,
    {MISMATCH} AS mismatch_type, {MISMATCH} <> '' AS mismatch_flag,
    CASE WHEN row_id % 4 = 0 THEN 'self_assessment' ELSE 'peer_feedback' END AS catme_subtype
  FROM merged)"""

JUDGED = FB + f""", judged AS (
  SELECT row_id, text, confidence,
    {names_sql(C.PEER_LABELS)}[((row_id * 7 + length(text)) % 7)::INT + 1] AS label,
    CASE WHEN row_id % 3 = 0 THEN {names_sql(C.PEER_LABELS)}[((row_id + length(text)) % 7)::INT + 1]
         ELSE {names_sql(C.PEER_LABELS)}[((row_id * 7 + length(text)) % 7)::INT + 1] END AS prediction
  FROM fb)"""

WIDE = """wide AS (
  SELECT doc_id AS row_id, source || '/' || lang AS entity,
    doc_id % 3 - 1 AS teaching, text AS teaching_text,
    doc_id % 5 % 3 - 1 AS labwork, lang || ' ' || source || ' ' || text AS labwork_text
  FROM documents)"""

CORRECTIONS = """corrections AS (
  SELECT doc_id AS row_id, CASE WHEN doc_id % 3 = 0 THEN 'approved' ELSE 'rejected' END AS decision FROM labels)"""


#: 240 phrases by rule, some of which begin alike, in eight categories.
LARGE_LEXICON = {
    f"Theme {c}": [f"{a}{b}{d}" for a in ("er", "an", "th", "on", "le", "in") for b in "aeiou"]
    for c, d in enumerate(("n", "r", "st", " t", " w", "ing", "que", " b"))
}


def categories_sql(text: str, lexicon: dict) -> str:
    return "concat_ws('|', " + ", ".join(f"CASE WHEN {any_sql(text, ps)} THEN '{c}' END" for c, ps in lexicon.items()) + ")"
