"""Pipelines, models and streams."""

import re
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedback_signals import config as C
from feedback_signals.catalog import frames as T
from feedback_signals.operators import aggregates as A, classifier as K, evaluation as E, signals as G, zero_shot as Z
from feedback_signals.plans import pipeline as PL, training as TR
from feedback_signals.sources import files, sinks
from feedback_signals.streaming import rate_cap as RC, score_stream as SS

OPTIONS = PL.Options(lexicon=T.LEXICON, settings=C.Settings(trees=10, eps=0.9))


def test_peer_chain(spark, sf_dir):
    source = T.feedback(spark, sf_dir).select("row_id", "text", F.col("entity").alias("teacher"), "rating")
    rows = PL.run_pipeline(source, OPTIONS, C.S2S).cache()
    assert rows.count() == source.filter(F.length("text") > 5).count()
    assert rows.select("row_id").distinct().count() == rows.count()
    allowed = set(C.PEER_LABELS + C.SELF_LABELS)
    assert {r.prediction for r in rows.filter("prediction IS NOT NULL").select("prediction").distinct().collect()} <= allowed
    # No word of any candidate: no label, no confidence, review, and no mismatch.
    words = {w for c in PL.DESCRIPTION_CLASSIFIERS[C.S2S]["labels"] for w in Z.candidate_words(c)}
    silent = [r for r in rows.collect() if not words & set(re.split("[^a-z]+", r.text.lower()))]
    assert len(silent) == rows.filter("prediction IS NULL").count() > 0
    assert all((r.prediction, r.confidence, r.needs_review, r.mismatch_flag) == (None, None, True, False) for r in silent)
    # The order of the stages: a mixed-signal row counts as real minority.
    mixed = rows.filter(F.contains("minority_category", F.lit(C.MIXED_SIGNAL)))
    assert mixed.filter("priority_score < 10").count() == 0
    assert rows.filter("keyword_minority AND NOT is_minority_pattern").count() == 0
    assert rows.filter(F.col("rating").isNull() & F.col("mismatch_flag")).count() == 0
    needed = {"feedback_mode", "catme_subtype", "confidence", "needs_review", "keyword_categories", "is_outlier",
              "is_noise", "cluster_id", "minority_category", "mismatch_type", "teacher"}
    assert needed <= set(rows.columns)


def test_course_chain_melts_and_masks(spark, sf_dir):
    wide = T.wide_course(spark, sf_dir).withColumnRenamed("entity", "teacher").withColumn(
        "teaching_text", F.concat(F.lit("John Smith said "), "teaching_text"))
    rows = PL.run_pipeline(wide, PL.Options(lexicon=T.LEXICON, include_minority=False), C.S2P).cache()
    assert {r.dimension for r in rows.select("dimension").distinct().collect()} == {"teaching", "labwork"}
    assert rows.filter(F.contains("text", F.lit("John Smith"))).count() == 0
    assert rows.select("row_id").distinct().count() == rows.count()
    assert "teacher" in rows.columns and rows.filter("cluster_id <> -1").count() == 0


def test_file_chain(spark, tmp_path):
    import csv

    path = str(tmp_path / "in.csv")
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["comment", "rating", "professor_id"])
        w.writerows([["The lab equipment is broken, says Ann Miller", 5, "p1"], ["professor is responsive and supportive", 1, "p1"], ["tiny", 3, "p2"]])
    rows = PL.run_file(spark, path, PL.Options(lexicon={"X": ["broken"]}, include_minority=False)).collect()
    assert [r.priority_score for r in rows] == sorted((r.priority_score for r in rows), reverse=True)
    first = next(r for r in rows if "broken" in r.text)
    assert first.text == "The lab equipment is broken, says [STUDENT]"
    assert first.mismatch_type == "HIGH_MISMATCH" and first.feedback_mode == C.S2P
    assert first.minority_category == "Mixed_Signal_Pattern|X" and first.priority_score == 10


def test_minority_chain_and_adhoc(spark, sf_dir):
    source = T.feedback(spark, sf_dir).select("row_id", "text")
    flagged, summary = PL.run_minority(source, OPTIONS)
    s = summary.first()
    assert s.flagged == flagged.count() and s.total == source.filter(F.length("text") > 5).count()
    adhoc = spark.createDataFrame([("professor is unavailable or dismissive",), ("teammate missed meetings or deadlines repeatedly",), ("",)], "text string")
    rows = {r.text: r for r in PL.score_texts(adhoc).collect()}
    a, b = (rows["professor is unavailable or dismissive"], rows["teammate missed meetings or deadlines repeatedly"])
    assert (a.prediction, a.broad_sentiment, a.priority_score, a.feedback_mode) == ("Support_Negative_Availability", "Negative", 7, C.S2P)
    assert (b.prediction, b.priority_score, b.feedback_mode) == ("Negative_Reliability", 9, C.S2S)


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    # The true label is a word of the text, so a model can learn it.
    rows = spark.range(400).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 8 == 0, "rare").when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("sentiment"),
    ).withColumn("text", F.concat_ws(" ", F.lit("this comment is"), "sentiment", F.lit("case"), F.col("row_id") % 7))
    ready = TR.prepare_training(rows)
    return ready, K.train_classifier(ready.rows.persist(), features=1 << 10, reg_params=(0.01, 1.0), max_iter=15)


def test_classifier(spark, trained, tmp_path):
    ready, model = trained
    assert model.labels == ("even", "odd", "rare") and model.metrics["minority_f1_mean"] > 0.9
    held_out = ready.rows.filter("is_test")
    scored = K.classify(held_out, model)
    report = {r.label: r for r in E.classification_report(scored).collect()}
    assert report["macro avg"].f1 > 0.9 and report["macro avg"].support == held_out.count()
    model.save(str(tmp_path / "m"))
    again = K.TextClassifier.load(spark, str(tmp_path / "m"))
    assert again.labels == model.labels
    same = lambda m: sorted((r.row_id, r.prediction, r.confidence) for r in K.classify(held_out, m).collect())
    assert same(again) == same(model)
    judged = K.evaluate(ready.rows.select("row_id", "text", "label"), ["text"], "label", model=model)
    sinks.save_metrics(judged, str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).first().total == ready.rows.count()
    unlabelled = K.evaluate(ready.rows.select("row_id", "text"), ["text"], model=model)
    assert E.confusion_matrix(unlabelled).count() == 0 and A.prediction_summary(unlabelled).first().total == ready.rows.count()


def test_classify_once_per_text(spark):
    df = spark.createDataFrame([(1, "lab equipment is broken"), (2, "lab equipment is broken"), (3, None)], "row_id long, text string")
    how = PL.DESCRIPTION_CLASSIFIERS[C.S2P]
    plain = {r.row_id: r.prediction for r in K.classify(df, **how).collect()}
    once = {r.row_id: r.prediction for r in K.classify(df.na.fill(""), **how, distinct=True).collect()}
    assert plain == once and plain[1] == "Lab_Negative_Equipment"


def test_unmatched_rows_get_scored_categories(spark):
    df = spark.createDataFrame([(1, "visa"), (2, "first generation"), (3, "zzz"), (4, "visa")], "row_id long, text string").withColumn("is_minority_pattern", F.col("row_id") < 4)
    got = {r.row_id: r.minority_category for r in G.categorize_flagged(df, {"Visa": ["visa"]}, scorer=Z.zero_shot_multi).collect()}
    assert got == {1: "Visa", 2: "First_Generation", 3: C.OUTLIER_ONLY, 4: ""}


def test_training_sets(spark, sf_dir):
    from feedback_signals.catalog import models

    labelled, heavy = TR.prepare_peer_training(T.feedback(spark, sf_dir).select("row_id", "text"))
    share = {r.sentiment: r.share for r in heavy.collect()}
    assert all(s > 0.3 for s in share.values()) and labelled.count() == 200
    course = models._course(spark, sf_dir)
    reviews = course.select(F.col("row_id") + 1000, "text", F.lit("tag").alias("tags")).toDF("row_id", "text", "tags")
    train, held_out = TR.prepare_course_training(reviews, course)
    assert train.count() + held_out.count() == reviews.count() + course.count()
    # Unlabelled are the reviews without a word of any candidate, and only they.
    words = {w for c in C.PROFESSOR_CANDIDATES for w in Z.candidate_words(c)}
    silent = {r.row_id for r in reviews.collect() if r.text.strip() and not words & set(re.split("[^a-z]+", r.text.lower()))}
    assert {r.row_id for r in train.filter("sentiment IS NULL").collect()} == silent
    assert not silent & {r.row_id for r in TR.clean_labelled(train, "sentiment").collect()}
    inside = {r.row_id for r in train.collect()}
    assert not inside & {r.row_id for r in held_out.collect()}
    by_rating = TR.label_held_out(course, by_rating=True)
    assert {r.sentiment for r in by_rating.collect()} <= {"Positive", "Neutral", "Negative"}


def model_of_cap(times, n, window):
    hits, out = [], []
    for t in times:
        hits = [h for h in hits if t - h < window]
        out.append(len(hits) < n)
        if out[-1]:
            hits.append(t)
    return out


DAY = 86_400_000


def cap_events(spark):
    rng = np.random.default_rng(4)
    rows = []
    for key, count, span in (("hot", 3000, 4000), ("cold", 30, 90_000), ("burst", 40, 3), ("edge", 0, 0)):
        for t in np.sort(rng.integers(0, span * 1000, count)) if count else [0, 0, 0, 59_999, 60_000, 60_000, 120_000]:
            rows.append((len(rows), key, int(t)))
    df = spark.createDataFrame(rows, "event_id long, key string, ms long")
    # A day after the epoch: a stream takes events at the epoch itself as late.
    return rows, df.select("event_id", "key", F.timestamp_millis(F.col("ms") + DAY).alias("ts")).repartition(6)


def expected_cap(rows, n):
    want = {}
    for key in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        want.update(zip((r[0] for r in own), model_of_cap([r[2] for r in own], n, 60_000)))
    return want


def test_a_client_that_never_pauses_is_many_slices(spark):
    """One key with most of the events, at several densities; slices start inside its
    only run, and some speculated states are wrong."""
    draw = random.Random(8)
    rows, t = [], 0
    for i in range(4000):
        t += draw.choice([0, 1, 1, 2, 7, 30]) * 1_000_000
        rows.append((i, "busy" if i % 10 else f"other {i % 7}", t))
    events = spark.createDataFrame(rows, "event_id long, key string, t long").select(
        "event_id", "key", F.timestamp_micros("t").alias("ts"), F.lit("wide").alias("note")
    ).repartition(5)
    want = {}
    for key in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == key]
        verdict = RC.accept(np.array([r[2] for r in mine]), deque(), 4, 60_000_000)
        want.update({r[0]: bool(v) for r, v in zip(mine, verdict)})
    for size in (10 ** 6, 200, 20):
        out = RC.rate_cap(events, n=4, slice_events=size)
        assert {r.event_id: r.accepted for r in out.collect()} == want and out.columns == [*events.columns, "accepted"]
    assert 0 < sum(want.values()) < len(want)


@pytest.mark.parametrize("n", [2, 5])
def test_rate_cap(spark, n):
    rows, events = cap_events(spark)
    keyless = spark.createDataFrame([(-1, None)], "event_id long, key string").withColumn("ts", F.current_timestamp())
    got = {r.event_id: r.accepted for r in RC.rate_cap(events.unionByName(keyless), n=n).collect()}
    assert got == {**expected_cap(rows, n), -1: None}


def test_sixth_is_refused_and_old_ones_do_not_count():
    assert RC.accept(np.array([0] * 6), deque(), 5, 60).tolist() == [True] * 5 + [False]
    assert RC.accept(np.array([120] * 5), deque([0] * 5), 5, 60).all()


def test_rate_cap_stream(spark, tmp_path):
    rows, events = cap_events(spark)
    ordered = events.orderBy("ts", "event_id").coalesce(1)
    folder = str(tmp_path / "events")
    for part in range(3):  # three files, in time order
        at = F.unix_millis("ts") - DAY
        ordered.filter((at >= part * 1_400_000) & (at < ((part + 1) * 1_400_000 if part < 2 else 1 << 60))).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("event_id long, key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    query = (RC.rate_cap_stream(stream, n=5).writeStream.format("memory").queryName("capped")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = {r.event_id: r.accepted for r in spark.table("capped").collect()}
    want = expected_cap(rows, 5)
    wrong = {i: (rows[i], got.get(i), want[i]) for i in want if got.get(i) != want[i]}
    assert not wrong and len(got) == len(want)


def test_score_stream_equals_batch(spark, sf_dir, tmp_path):
    source = T.feedback(spark, sf_dir).select("row_id", "text", "rating")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    source.repartition(4).write.parquet(folder)
    query = SS.score_stream(spark, folder, out, "row_id long, text string, rating double", C.S2P, OPTIONS, str(tmp_path / "cp"), files_per_batch=1)
    query.awaitTermination(180)
    assert query.exception() is None
    streamed = spark.read.parquet(f"{out}/rows").drop("batch_id")
    batch = SS.score_batch(source, C.S2P, OPTIONS)
    key = lambda df: sorted(map(str, df.select(sorted(batch.columns)).collect()))
    assert key(streamed) == key(batch)
    totals = {r.label: (r["count"], r.minority_count) for r in SS.stream_totals(spark, out).collect()}
    stats = {r.label: (r["count"], r.minority_count) for r in A.label_stats(batch).collect()}
    assert totals == stats


def test_score_stream_goes_on_and_starts_again(spark, sf_dir, tmp_path):
    source = T.feedback(spark, sf_dir).select("row_id", "text", "rating")
    folder, out, state = (str(tmp_path / name) for name in ("in", "out", "cp"))
    start = lambda trigger: SS.score_stream(
        spark, folder, out, "row_id long, text string, rating double", C.S2P, OPTIONS, state, trigger=trigger
    )
    source.filter("row_id % 3 = 0").coalesce(1).write.mode("append").parquet(folder)
    query = start({"processingTime": "1 second"})
    try:
        query.processAllAvailable()
        source.filter("row_id % 3 = 1").coalesce(1).write.mode("append").parquet(folder)
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    source.filter("row_id % 3 = 2").coalesce(1).write.mode("append").parquet(folder)
    query = start(None)
    query.awaitTermination(180)
    assert query.exception() is None and not query.isActive
    ids = [r.row_id for r in spark.read.parquet(f"{out}/rows").select("row_id").collect()]
    wanted = [r.row_id for r in SS.score_batch(source, C.S2P, OPTIONS).select("row_id").collect()]
    assert sorted(ids) == sorted(wanted)


def test_loaded_lexicon_drives_the_chain(spark, tmp_path):
    spark.createDataFrame([("A", 0, "the"), ("B", 1, "zz")], "category string, ord int, phrase string").write.parquet(str(tmp_path / "lex"))
    assert files.read_lexicon(spark, str(tmp_path / "lex")) == {"A": ["the"], "B": ["zz"]}
