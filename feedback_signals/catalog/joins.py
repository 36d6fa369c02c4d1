"""Lookups, caches, neighbours and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..operators import caches, evaluation as E, labelling, neighbors, zero_shot as Z
from ..plans import training as TR
from . import frames as T
from .registry import ORACLES, query

# The first half of the label vocabulary of the turns is "known".
_CACHE = """cache AS (SELECT sha256(text) AS h, min(role) AS label FROM conversations GROUP BY text)"""


def _label_cache(spark, sf):
    rows = T.table(spark, sf, "conversations").withColumn("text_hash", F.sha2("text", 256))
    return rows.groupBy("text_hash").agg(F.min("role").alias("label"))


def _texts(spark, sf):
    """Documents and conversation turns together: only the latter are cached."""
    docs = T.table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    turns = T.table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return docs.union(turns)


_TEXTS = """texts AS (SELECT 'd' || doc_id AS id, text FROM documents
  UNION ALL SELECT conv_id || '-' || turn, text FROM conversations)"""


@query("apply_label_cache", f"""
WITH {_CACHE}, {_TEXTS} SELECT t.id, c.label FROM texts t LEFT JOIN cache c ON c.h = sha256(t.text)""")
def apply_label_cache(spark, sf):
    return caches.apply_cache(_texts(spark, sf), _label_cache(spark, sf), "label").select("id", "label")


@query("not_in_label_cache", f"""
WITH {_CACHE}, {_TEXTS} SELECT t.id FROM texts t WHERE sha256(t.text) NOT IN (SELECT h FROM cache)""")
def not_in_label_cache(spark, sf):
    return caches.not_cached(_texts(spark, sf), _label_cache(spark, sf)).select("id")


@query("apply_embedding_cache", """
SELECT d.doc_id, e.vec_id, round(e.embedding[1]::DOUBLE, 9) AS first_value FROM documents d LEFT JOIN embeddings e
  ON e.vec_id = (SELECT min(x.doc_id) FROM documents x WHERE x.text = d.text)""")
def apply_embedding_cache(spark, sf):
    docs = T.table(spark, sf, "documents").withColumnRenamed("doc_id", "row_id")
    keys = caches.distinct_texts(docs).select("text_hash", F.col("row_id").alias("vec_id"))
    cache = keys.join(T.table(spark, sf, "embeddings"), "vec_id").select(
        "text_hash", F.struct("vec_id", "embedding").alias("v")
    )
    rows = caches.apply_cache(docs, cache, "v")
    return rows.select(
        F.col("row_id").alias("doc_id"), "v.vec_id", F.round(F.col("v.embedding")[0].cast("double"), 9).alias("first_value")
    )


@query("map_labels", """
WITH c AS (SELECT doc_id, ['professor is responsive and supportive', 'professor is unavailable or dismissive', 'no such text'][(doc_id % 3)::INT + 1] AS candidate FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Support_Positive' WHEN 1 THEN 'Support_Negative_Availability' ELSE 'Majority_Positive' END AS label FROM c""")
def map_labels(spark, sf):
    names = ["professor is responsive and supportive", "professor is unavailable or dismissive", "no such text"]
    rows = T.table(spark, sf, "documents").select("doc_id", T.pick(names, F.col("doc_id") % 3).alias("candidate"))
    return labelling.map_labels(rows, C.PROFESSOR_CANDIDATES).select("doc_id", "label")


def _dimension_values() -> str:
    rows = []
    described = {v: k for k, v in C.PROFESSOR_CANDIDATES.items()}
    for (dimension, bucket), labels in C.DIMENSION_LABELS.items():
        rows.append(f"('{dimension}', '{bucket}', '{'; '.join(described[l] for l in labels)}')")
    return ", ".join(rows)


_DIMENSIONS = ("teaching", "course_content", "examination", "lab_work", "library", "extracurricular", "parking")


@query("dimension_candidates", f"""
WITH t(dimension, bucket, names) AS (VALUES {_dimension_values()}),
d AS (SELECT doc_id, {T.names_sql(_DIMENSIONS)}[(doc_id % 7)::INT + 1] AS dimension, n_chars % 3 - 1 AS rating FROM documents)
SELECT doc_id, CASE WHEN rating > 0 THEN 'positive' WHEN rating < 0 THEN 'negative' ELSE 'neutral' END AS rating_bucket,
  coalesce(names, 'generic positive feedback about the course') AS candidates
FROM d LEFT JOIN t ON t.dimension = replace(d.dimension, '_', '')
  AND t.bucket = CASE WHEN rating > 0 THEN 'positive' WHEN rating < 0 THEN 'negative' ELSE 'neutral' END""")
def dimension_candidates(spark, sf):
    rows = T.table(spark, sf, "documents").select(
        "doc_id", T.pick(_DIMENSIONS, F.col("doc_id") % 7).alias("dimension"), (F.col("n_chars") % 3 - 1).alias("rating")
    )
    return Z.dimension_candidates(rows).select(
        "doc_id", "rating_bucket", F.array_join("candidates", "; ").alias("candidates")
    )


@query("keep_known_labels", f"""
WITH {T.FB}, {T.CORRECTIONS}, known AS (SELECT DISTINCT prediction FROM fb JOIN corrections USING (row_id) WHERE decision = 'approved' AND confidence > 0.8)
SELECT row_id, prediction FROM fb WHERE prediction IN (SELECT prediction FROM known)""")
def keep_known_labels(spark, sf):
    rows = T.feedback(spark, sf)
    approved = T.corrections(spark, sf).filter("decision = 'approved'")
    train = rows.filter("confidence > 0.8").join(approved, "row_id", "left_semi")
    return E.keep_known_labels(rows, train, "prediction").select("row_id", "prediction")


@query("align_by_row", f"WITH {T.FB} SELECT row_id, prediction FROM fb WHERE row_id IN (SELECT doc_id FROM labels)")
def align_by_row(spark, sf):
    subset = T.table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"))
    return TR.align_by_row(T.feedback(spark, sf), subset).select("row_id", "prediction")


@query("first_label_per_text", f"""
WITH {T.FB} SELECT row_id, first_value(prediction) OVER (PARTITION BY text ORDER BY row_id) AS prediction FROM fb""")
def first_label_per_text(spark, sf):
    rows = caches.with_key(T.feedback(spark, sf))
    return labelling.first_label_per_text(rows, "prediction").select("row_id", "prediction")


def points(spark, sf):
    return T.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "row_id")


def references(spark, sf):
    """Candidate descriptions stand for references: one vector per label."""
    e = points(spark, sf)
    first = e.groupBy("label").agg(F.min("row_id").alias("row_id"))
    return e.join(first, ["row_id", "label"]).select(F.col("row_id").alias("ref_id"), "embedding")


POINTS = "p AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


@query("nearest_neighbor", f"""
WITH {POINTS}, r AS (SELECT row_id AS ref_id, v FROM p WHERE row_id IN (SELECT min(row_id) FROM p GROUP BY label))
SELECT p.row_id, first(ref_id ORDER BY list_distance(p.v, r.v), ref_id) AS nearest_id FROM p, r GROUP BY p.row_id""")
def nearest_neighbor(spark, sf):
    return neighbors.nearest_neighbor(points(spark, sf), references(spark, sf)).select("row_id", "nearest_id")


EPS = 1.2


@query("eps_neighbors", f"""
WITH {POINTS} SELECT a.row_id, count(*) AS neighbors FROM p a, p b WHERE list_distance(a.v, b.v) <= {EPS} GROUP BY a.row_id""")
def eps_neighbors(spark, sf):
    return neighbors.eps_neighbors(points(spark, sf), EPS).select("row_id", "neighbors")


@query("eps_neighbors_small_cells", ORACLES["eps_neighbors"])
def eps_neighbors_small_cells(spark, sf):
    return neighbors.eps_neighbors(points(spark, sf), EPS, block_rows=128).select("row_id", "neighbors")


@query("nearest_neighbor_by_cells", f"""
WITH {POINTS}, r AS (SELECT * FROM p WHERE row_id % 2 = 0)
SELECT p.row_id, first(r.row_id ORDER BY list_distance(p.v, r.v), r.row_id) AS nearest_id FROM p, r GROUP BY p.row_id""")
def nearest_neighbor_by_cells(spark, sf):
    refs = points(spark, sf).filter("row_id % 2 = 0").select(F.col("row_id").alias("ref_id"), "embedding")
    return neighbors.nearest_neighbor(points(spark, sf), refs, max_refs=0, cell_rows=64).select("row_id", "nearest_id")


@query("combine_training", """
WITH h AS (SELECT doc_id AS row_id, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT / 4294967296 < 0.2 AS is_test FROM documents)
SELECT 'train' AS side, conv_id * 1000 + turn AS row_id, role AS tags, NULL AS dimension FROM conversations
UNION ALL SELECT 'train', row_id, NULL, 'parking' FROM h WHERE NOT is_test
UNION ALL SELECT 'validation', row_id, NULL, 'parking' FROM h WHERE is_test""")
def combine_training(spark, sf):
    reviews = T.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text", F.col("role").alias("tags")
    )
    course = T.documents(spark, sf).select(
        F.col("doc_id").alias("row_id"), "text", F.lit("parking").alias("dimension"), F.lit(1).alias("rating")
    )
    train, held_out = TR.combine_training(reviews, course)
    side = lambda rows, name: rows.select(F.lit(name).alias("side"), "row_id", "tags", "dimension")
    return side(train, "train").union(side(held_out.withColumn("tags", F.lit(None).cast("string")), "validation"))
