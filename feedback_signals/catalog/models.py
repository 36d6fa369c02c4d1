"""Model-based operators, whole pipelines and the rate cap."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..operators import classifier, dbscan as D, detect, embeddings, evaluation as E, outliers, zero_shot as Z
from ..plans import pipeline as PL, training as TR
from ..session import materialize, scratch_folder
from ..sources import loaders
from ..streaming import rate_cap as RC, score_stream as SS
from . import frames as T
from .joins import EPS, POINTS, points
from .registry import ORACLES, query
from .rows import BODY, MASKED_NAMES
from .samples import HASH

OPTIONS = PL.Options(lexicon=T.LEXICON)


# --------------------------------------------------------------- candidates
def _values(candidates) -> str:
    return ", ".join(f"({i}, '{c}', '{l}')" for i, (c, l) in enumerate(candidates.items()))


def _cosine_sql(candidates, source: str = "documents") -> str:
    """Scores of every (text, candidate), from the definition of the weights; none, and
    no label, for a text that has no word of any candidate."""
    return f"""cand(ord, name, label) AS (VALUES {_values(candidates)}),
words AS (SELECT DISTINCT ord, unnest(regexp_extract_all(lower(name), '[a-z]+')) AS w FROM cand),
weight AS (SELECT w, round(1000 * pow(ln(({len(candidates)}::DOUBLE + 1) / (1 + count(*))) + 1, 2))::BIGINT AS q FROM words GROUP BY w),
size AS (SELECT ord, sqrt(sum(q)::DOUBLE) AS norm FROM words JOIN weight USING (w) GROUP BY ord),
hits AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM {source}),
own AS (SELECT doc_id, sqrt(sum(q)::DOUBLE) AS norm FROM hits JOIN weight USING (w) GROUP BY doc_id),
shared AS (SELECT doc_id, ord, sum(q)::DOUBLE AS s FROM hits JOIN weight USING (w) JOIN words USING (w) GROUP BY doc_id, ord),
scores AS (SELECT d.doc_id, c.ord, c.name, c.label, CASE WHEN o.norm IS NOT NULL THEN coalesce(s.s / z.norm / o.norm, 0) END AS score
  FROM {source} d CROSS JOIN cand c JOIN size z USING (ord) LEFT JOIN own o USING (doc_id) LEFT JOIN shared s USING (doc_id, ord)),
best AS (SELECT doc_id, CASE WHEN score IS NOT NULL THEN name END AS name, CASE WHEN score IS NOT NULL THEN label END AS label, score
  FROM scores QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC NULLS LAST, ord) = 1)"""


def _documents(spark, sf):
    return T.documents(spark, sf).withColumnRenamed("doc_id", "row_id")


@query("argmax_label", f"WITH {_cosine_sql(C.PEER_CANDIDATES)} SELECT doc_id AS row_id, name AS candidate, round(score, 9) AS score FROM best")
def argmax_label(spark, sf):
    best = Z.best_candidate(_documents(spark, sf), list(C.PEER_CANDIDATES))
    return best.select("row_id", "candidate", F.round("score", 9).alias("score"))


_BLANK = r"regexp_replace(text, '\s+', '', 'g') = ''"


@query("zero_shot_label", f"""
WITH {_cosine_sql(C.PROFESSOR_CANDIDATES)}
SELECT doc_id AS row_id, CASE WHEN {_BLANK} THEN '' ELSE label END AS sentiment FROM best JOIN documents USING (doc_id)""")
def zero_shot_label(spark, sf):
    return Z.zero_shot_label(_documents(spark, sf), C.PROFESSOR_CANDIDATES).select("row_id", "sentiment")


@query("classify", f"""
WITH {_cosine_sql(C.PROFESSOR_CANDIDATES)}
SELECT doc_id AS row_id, label AS prediction, coalesce(score < 0.65, true) AS needs_review FROM best""")
def classify(spark, sf):
    rows = classifier.classify(_documents(spark, sf), **PL.DESCRIPTION_CLASSIFIERS[C.S2P])
    return rows.select("row_id", "prediction", "needs_review")


_CATEGORIES = {c: c for c in C.MINORITY_CATEGORIES if c not in C.NON_EXPERIENCE_CATEGORIES}


@query("zero_shot_multi", f"""
WITH {_cosine_sql(_CATEGORIES)}
SELECT doc_id AS row_id, coalesce(string_agg(label, '|' ORDER BY ord) FILTER (score >= 0.5), 'Statistical_Outlier_Only') AS categories
FROM scores GROUP BY doc_id""")
def zero_shot_multi(spark, sf):
    return Z.zero_shot_multi(_documents(spark, sf)).select("row_id", "categories")


_DIMENSIONS = ("teaching", "course_content", "examination", "lab_work", "library", "parking")


def _course(spark, sf):
    return _documents(spark, sf).withColumns({
        "dimension": T.pick(_DIMENSIONS, F.col("row_id") % 6),
        "rating": F.col("n_chars") % 3 - 1,
    }).select("row_id", "text", "dimension", "rating")


def _allowed() -> str:
    rows = [
        f"('{d}', '{b}', '{l}')" for (d, b), labels in C.DIMENSION_LABELS.items() for l in labels
    ]
    return ", ".join(rows)


_BY_DIMENSION = f"""{_cosine_sql(C.PROFESSOR_CANDIDATES)}, allowed(dimension, bucket, label) AS (VALUES {_allowed()}),
d AS (SELECT doc_id, text, replace({T.names_sql(_DIMENSIONS)}[(doc_id % 6)::INT + 1], '_', '') AS dimension,
  ['negative', 'neutral', 'positive'][(n_chars % 3)::INT + 1] AS bucket FROM documents),
own_best AS (SELECT doc_id, s.label FROM d JOIN allowed a USING (dimension, bucket) JOIN scores s USING (doc_id)
  WHERE s.label = a.label QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, s.ord) = 1),
each AS (SELECT d.doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, coalesce(b.label, 'Majority_Positive') AS label FROM d LEFT JOIN own_best b USING (doc_id)),
by_dimension AS (SELECT doc_id AS row_id, first_value(label) OVER (PARTITION BY text ORDER BY doc_id) AS sentiment FROM each)"""


@query("label_by_dimension", f"WITH {_BY_DIMENSION} SELECT row_id, sentiment FROM by_dimension")
def label_by_dimension(spark, sf):
    return Z.label_by_dimension(_course(spark, sf)).select("row_id", "sentiment")


# ------------------------------------------------------------------ density
def _dbscan_sql(source: str, eps: float) -> str:
    """Core points, reachability by recursion, border points to the lowest
    numbered cluster."""
    return f"""near AS (SELECT a.row_id AS a, b.row_id AS b FROM {source} a, {source} b WHERE list_distance(a.v, b.v) <= {eps}),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
link AS MATERIALIZED (SELECT a, b FROM near WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS c FROM (SELECT DISTINCT root FROM root)),
cored AS (SELECT id, c FROM root JOIN num USING (root)),
border AS (SELECT n.a AS id, min(c) AS c FROM near n JOIN cored k ON n.b = k.id WHERE n.a NOT IN (SELECT id FROM core) GROUP BY n.a),
clustered AS (SELECT p.row_id, p.v, coalesce(k.c, b.c, -1) AS cluster_id FROM {source} p LEFT JOIN cored k ON k.id = p.row_id LEFT JOIN border b ON b.id = p.row_id)"""


@query("dbscan", f"WITH RECURSIVE {POINTS}, {_dbscan_sql('p', EPS)} SELECT row_id, cluster_id FROM clustered")
def dbscan(spark, sf):
    return D.dbscan(points(spark, sf), EPS).select("row_id", "cluster_id")


@query("dbscan_small_cells", ORACLES["dbscan"])
def dbscan_small_cells(spark, sf):
    return D.dbscan(points(spark, sf), EPS, block_rows=128).select("row_id", "cluster_id")


# Two hundred sampled points leave fewer neighbours, so the radius is wider.
SAMPLE, SAMPLE_EPS = 200, 1.24


@query("dbscan_sampled", f"""
WITH RECURSIVE {POINTS}, s AS (SELECT * FROM p ORDER BY md5('43:' || row_id), row_id LIMIT {SAMPLE}), {_dbscan_sql('s', SAMPLE_EPS)}
SELECT p.row_id, first(c.cluster_id ORDER BY list_distance(p.v, c.v), c.row_id) AS cluster_id FROM p, clustered c GROUP BY p.row_id""")
def dbscan_sampled(spark, sf):
    return D.dbscan_sampled(points(spark, sf), SAMPLE, SAMPLE_EPS).select("row_id", "cluster_id")


@query("small_clusters", """
WITH c AS (SELECT row_id, CASE WHEN label = 0 THEN -1 ELSE label * 1000 + row_id // 60 END AS cluster_id, row_id % 11 = 0 AS is_outlier
  FROM (SELECT vec_id AS row_id, label FROM embeddings)),
z AS (SELECT cluster_id, count(*) AS n FROM c WHERE cluster_id <> -1 GROUP BY 1)
SELECT row_id, coalesce(n < 10, false) AS is_minority_cluster, c.cluster_id = -1 AS is_noise,
  is_outlier OR coalesce(n < 10, false) AS is_minority_pattern FROM c LEFT JOIN z USING (cluster_id)""")
def small_clusters(spark, sf):
    rows = points(spark, sf).withColumns({
        "cluster_id": F.when(F.col("label") == 0, -1).otherwise(F.col("label") * 1000 + F.floor(F.col("row_id") / 60)),
        "is_outlier": F.col("row_id") % 11 == 0,
    })
    marked = D.small_clusters(rows, 10)
    return marked.select("row_id", "is_minority_cluster", "is_noise", "is_minority_pattern")


@query("isolation_outliers")
def isolation_outliers(spark, sf):
    return outliers.isolation_outliers(points(spark, sf)).select("row_id", "anomaly_score", "is_outlier")


@query("embed_texts")
def embed_texts(spark, sf):
    rows = embeddings.embed_texts(_documents(spark, sf).select("row_id", "text"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return rows.select("row_id", F.size("embedding").alias("dims"), F.round(norm, 5).alias("norm"), "embedding")


@query("detect_minority")
def detect_minority(spark, sf):
    rows = detect.detect_minority(T.feedback(spark, sf), T.LEXICON)
    return rows.select("row_id", "is_outlier", "is_minority_cluster", "is_noise", "cluster_id", "is_minority_pattern", "minority_category")


# -------------------------------------------------------------- classifiers
def _trained(spark, sf):
    truth = T.table(spark, sf, "labels").select(
        F.col("doc_id").alias("row_id"), F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("sentiment")
    )
    ready = TR.prepare_training(T.feedback(spark, sf).select("row_id", "text").join(truth, "row_id"))
    rows = materialize(ready.rows)
    return rows, classifier.train_classifier(rows)


@query("train_classifier")
def train_classifier(spark, sf):
    rows, model = _trained(spark, sf)
    scored = classifier.classify(rows.filter("is_test"), model)
    return E.classification_report(scored)


@query("evaluate")
def evaluate(spark, sf):
    rows, model = _trained(spark, sf)
    judged = classifier.evaluate(rows.filter("is_test").select("row_id", "text", "label"), ["text"], "label", model=model)
    return E.confusion_matrix(judged)


@query("route_model", f"""
WITH a AS (WITH {_cosine_sql({**C.PEER_CANDIDATES, **C.SELF_CANDIDATES})} SELECT doc_id, label FROM best),
b AS (WITH {_cosine_sql(C.PROFESSOR_CANDIDATES)} SELECT doc_id, label FROM best)
SELECT doc_id AS row_id, CASE WHEN doc_id % 2 = 0 THEN a.label ELSE b.label END AS prediction FROM a JOIN b USING (doc_id)""")
def route_model(spark, sf):
    mode = F.when(F.col("row_id") % 2 == 0, C.S2S).otherwise(C.S2P)
    rows = _documents(spark, sf).withColumn("feedback_mode", mode)
    return classifier.route_model(rows, PL.DESCRIPTION_CLASSIFIERS).select("row_id", "prediction")


# ---------------------------------------------------------------- pipelines
def _wide(spark, sf):
    return T.wide_course(spark, sf).withColumnRenamed("entity", "teacher")


@query("run_course_scoring")
def run_course_scoring(spark, sf):
    rows = PL.run_pipeline(_wide(spark, sf), OPTIONS, C.S2P)
    return rows.select("row_id", "dimension", "prediction", "is_minority_pattern", "minority_category", "priority_score")


@query("run_peer_scoring")
def run_peer_scoring(spark, sf):
    source = T.feedback(spark, sf).select("row_id", "text", "entity", "rating").withColumnRenamed("entity", "teacher")
    rows = PL.run_pipeline(source, OPTIONS, C.S2S)
    return rows.select("row_id", "catme_subtype", "prediction", "is_minority_pattern", "priority_score", "mismatch_type")


@query("run_minority")
def run_minority(spark, sf):
    flagged, _ = PL.run_minority(T.feedback(spark, sf).select("row_id", "text"), OPTIONS)
    return flagged.drop("feedback")


def _hits_sql(words) -> str:
    return " + ".join(f"contains(lower(text), '{w}')::INT" for w in words)


@query("score_texts", f"""
WITH documents AS (SELECT conv_id * 1000000 + turn AS doc_id, conv_id, turn, text FROM conversations),
a AS (WITH {_cosine_sql({**C.PEER_CANDIDATES, **C.SELF_CANDIDATES})} SELECT doc_id, label, score FROM best),
b AS (WITH {_cosine_sql(C.PROFESSOR_CANDIDATES)} SELECT doc_id, label, score FROM best),
m AS (SELECT doc_id, conv_id, turn, {_hits_sql(C.PEER_SIGNALS)} >= {_hits_sql(C.PROFESSOR_SIGNALS)} AS peer FROM documents),
r AS (SELECT conv_id, turn, CASE WHEN peer THEN a.label ELSE b.label END AS prediction,
  round(CASE WHEN peer THEN a.score ELSE b.score END, 4) AS confidence FROM m JOIN a USING (doc_id) JOIN b USING (doc_id))
SELECT conv_id, turn, prediction, {T.BROAD.format(c='prediction')} AS broad_sentiment, {T.priority_sql('false')} AS priority_score FROM r""")
def score_texts(spark, sf):
    rows = PL.score_texts(T.table(spark, sf, "conversations"))
    return rows.select("conv_id", "turn", "prediction", "broad_sentiment", "priority_score")


_SUBTYPE = f"""typed AS (SELECT doc_id, text, {_hits_sql(p.replace("'", "''") for p in C.FIRST_PERSON_PHRASES)} AS hits,
  CASE WHEN {BODY} = '' THEN 0 ELSE len(regexp_split_to_array({BODY}, '\\s+')) END AS words FROM documents),
masked AS (SELECT doc_id, {MASKED_NAMES} AS text,
  CASE WHEN hits >= 2 OR (hits = 1 AND words < 30) THEN 'self_assessment' ELSE 'peer_feedback' END AS subtype FROM typed)"""


@query("prepare_peer_training", f"""
WITH {_SUBTYPE},
a AS (WITH {_cosine_sql(C.CANDIDATE_LABELS[C.PEER], "masked")} SELECT doc_id, label FROM best),
b AS (WITH {_cosine_sql(C.CANDIDATE_LABELS[C.SELF], "masked")} SELECT doc_id, label FROM best)
SELECT subtype, CASE WHEN {_BLANK} THEN '' WHEN subtype = 'peer_feedback' THEN a.label ELSE b.label END AS sentiment, count(*) AS n
FROM masked JOIN a USING (doc_id) JOIN b USING (doc_id) GROUP BY 1, 2""")
def prepare_peer_training(spark, sf):
    labelled, _ = TR.prepare_peer_training(_documents(spark, sf).select("row_id", "text"))
    return labelled.groupBy("subtype", "sentiment").agg(F.count("*").alias("n"))


@query("prepare_course_training", f"""
WITH {_BY_DIMENSION}, reviews AS (SELECT doc_id AS row_id, text FROM documents JOIN (SELECT row_id AS doc_id, rating FROM (WITH {T.FB} SELECT * FROM fb))
  USING (doc_id) WHERE length({BODY}) > 10
  QUALIFY row_number() OVER (PARTITION BY CASE WHEN rating >= 4 THEN 1 WHEN rating >= 3 THEN 0 ELSE -1 END ORDER BY {HASH}, row_id) <= 50000),
halves AS (SELECT *, ('0x' || substr({HASH}, 1, 8))::BIGINT / 4294967296 < 0.2 AS is_test FROM by_dimension),
sides AS (SELECT 'train' AS side, label AS sentiment FROM reviews JOIN best ON row_id = doc_id
  UNION ALL SELECT CASE WHEN is_test THEN 'validation' ELSE 'train' END, sentiment FROM halves)
SELECT side, sentiment, count(*) AS n FROM sides GROUP BY ALL""")
def prepare_course_training(spark, sf):
    reviews = loaders.review_rows(T.feedback(spark, sf).select(
        "row_id", F.col("rating").alias("quality"), F.col("text").alias("comment"), F.col("entity").alias("tags")
    ))
    train, held_out = TR.prepare_course_training(reviews, _course(spark, sf))
    side = lambda rows, name: rows.select(F.lit(name).alias("side"), "sentiment")
    both = side(train, "train").union(side(held_out, "validation"))
    return both.groupBy("side", "sentiment").agg(F.count("*").alias("n"))


# One step per event of a key: the state is the list of accepted times of the last day.
_RATE_CAP = """
WITH RECURSIVE e AS (
  SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS i FROM events
), s AS (
  SELECT user_id, i, event_id, [t] AS held, true AS accepted FROM e WHERE i = 1 AND user_id IS NOT NULL
  UNION ALL
  SELECT user_id, i, event_id, CASE WHEN len(kept) < 3 THEN list_append(kept, t) ELSE kept END, len(kept) < 3
  FROM (SELECT e.user_id, e.i, e.event_id, e.t, list_filter(s.held, lambda x: e.t - x < 86400000000) AS kept
        FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
)
SELECT e.event_id, s.accepted FROM e LEFT JOIN s USING (event_id)"""


@query("rate_cap", _RATE_CAP)
def rate_cap(spark, sf):
    events = T.table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), "ts")
    return RC.rate_cap(events, n=3, seconds=24 * 3600).select("event_id", "accepted")


@query("rate_cap_small_slices", _RATE_CAP)
def rate_cap_small_slices(spark, sf):
    events = T.table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), "ts")
    return RC.rate_cap(events, n=3, seconds=24 * 3600, slice_events=8).select("event_id", "accepted")


@query("score_stream", f"""
WITH masked AS (SELECT doc_id, {MASKED_NAMES} AS text FROM documents WHERE length(text) > 5), {_cosine_sql(C.PROFESSOR_CANDIDATES, "masked")}
SELECT label, count(*) AS count FROM best WHERE label IS NOT NULL GROUP BY label""")
def score_stream(spark, sf):
    """Runs the stream over the files that are there and returns its totals."""
    out = f"{scratch_folder(spark)}/streams/{uuid.uuid4().hex}"
    job = SS.score_stream(
        spark, f"{sf}/documents*.parquet", f"{out}/result", "doc_id long, text string", C.S2P, OPTIONS, f"{out}/progress"
    )
    job.awaitTermination()
    return SS.stream_totals(spark, f"{out}/result").select("label", "count")
