"""Reproducible random choices and label encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as M
from ..plans import training as TR
from . import frames as T
from .registry import query

HASH = "md5('42:' || row_id)"


@query("stratified_cap", f"""
WITH {T.FB} SELECT row_id, prediction FROM fb QUALIFY row_number() OVER (PARTITION BY prediction ORDER BY {HASH}, row_id) <= 20""")
def stratified_cap(spark, sf):
    return M.stratified_cap(T.feedback(spark, sf), "prediction", 20).select("row_id", "prediction")


def _skewed(spark, sf):
    """A label column in which one class is far larger than the others."""
    return T.feedback(spark, sf).withColumn(
        "label", F.when(F.col("row_id") % 10 < 7, "big").otherwise(F.concat(F.lit("small"), F.col("row_id") % 3))
    )


_SKEWED = f"""{T.FB}, sk AS (SELECT row_id, text, CASE WHEN row_id % 10 < 7 THEN 'big' ELSE 'small' || (row_id % 3) END AS label FROM fb)"""


@query("undersample", f"""
WITH {_SKEWED}, c AS (SELECT label, count(*) AS n FROM sk GROUP BY label),
cap AS (SELECT (n * 2)::BIGINT AS cap FROM c ORDER BY n DESC LIMIT 1 OFFSET 1)
SELECT row_id, label FROM sk, cap QUALIFY row_number() OVER (PARTITION BY label ORDER BY {HASH}, row_id) <= cap""")
def undersample(spark, sf):
    return M.undersample(_skewed(spark, sf), ratio=2).select("row_id", "label")


_SPLIT = f"""{T.FB}, ranked AS (SELECT row_id, prediction, row_number() OVER (PARTITION BY prediction ORDER BY {HASH}, row_id) AS k,
  count(*) OVER (PARTITION BY prediction) AS n FROM fb)"""


@query("stratified_split", f"WITH {_SPLIT} SELECT row_id, prediction, k <= floor(0.2::DOUBLE * n + 0.5) AS is_test FROM ranked")
def stratified_split(spark, sf):
    return M.stratified_split(T.feedback(spark, sf), "prediction").select("row_id", "prediction", "is_test")


@query("random_split", f"""
WITH {T.FB} SELECT row_id, ('0x' || substr({HASH}, 1, 8))::BIGINT / 4294967296 < 0.2 AS is_test FROM fb""")
def random_split(spark, sf):
    return M.random_split(T.feedback(spark, sf)).select("row_id", "is_test")


@query("sample_n", f"WITH {T.FB} SELECT row_id FROM fb ORDER BY {HASH}, row_id LIMIT 150")
def sample_n(spark, sf):
    return M.sample_n(T.feedback(spark, sf), 150).select("row_id")


@query("encode_labels", f"""
WITH {T.FB}, d AS (SELECT DISTINCT prediction AS label FROM fb) SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS label_id FROM d""")
def encode_labels(spark, sf):
    rows = T.feedback(spark, sf).select(F.col("prediction").alias("label"))
    return M.encode_labels(rows)


_BODY = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query("prepare_training", f"""
WITH {_SKEWED}, clean AS (SELECT row_id, {_BODY} AS text, label FROM sk WHERE length(text) > 10),
c AS (SELECT label, count(*) AS n FROM clean GROUP BY label),
cap AS (SELECT (n * 3)::BIGINT AS cap FROM c ORDER BY n DESC LIMIT 1 OFFSET 1),
kept AS (SELECT row_id, text, label FROM clean, cap QUALIFY row_number() OVER (PARTITION BY label ORDER BY {HASH}, row_id) <= cap),
ids AS (SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS label_id FROM (SELECT DISTINCT label FROM kept)),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {HASH}, row_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM kept)
SELECT r.row_id, length(r.text) AS n_chars, r.label, ids.label_id, k <= floor(0.2::DOUBLE * n + 0.5) AS is_test FROM r JOIN ids USING (label)""")
def prepare_training(spark, sf):
    ready = TR.prepare_training(_skewed(spark, sf), "label")
    return ready.rows.select("row_id", F.length("text").cast("long").alias("n_chars"), "label", "label_id", "is_test")
