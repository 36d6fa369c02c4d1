import random
import re

import pytest
from pyspark.sql import functions as F

from feedback_signals import config as C
from feedback_signals.functions import labels as L, lexicon as X, scoring as S, text as T
from feedback_signals.operators import aggregates as A, classifier as K, entities as N, labelling, reshape as R, signals as G, zero_shot as Z
from feedback_signals.plans import pipeline as PL


def values(df, col="v"):
    return [r[col] for r in df.collect()]


def texts(spark, *items):
    return spark.createDataFrame([(i, t) for i, t in enumerate(items)], "row_id long, text string").coalesce(1)


def test_anonymize(spark):
    df = R.anonymize(texts(spark, "I met John Smith today", "", "   ", "no name here", "Ann Lee Bob Ray", "XJohn Smith", "Éric Dupont", "Jo Smith", None))
    assert values(df, "text") == [
        "I met [STUDENT] today", "", "   ", "no name here", "[STUDENT] [STUDENT]", "XJohn Smith", "Éric Dupont", "Jo Smith", None,
    ]


def test_name_pattern_equals_plain_form(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    ours = [r[0] for r in docs.select(T.masked_names(F.col("text"))).collect()]
    plain = [re.sub(r"\b[A-Z][a-z]{2,}\s+[A-Z][a-z]{2,}\b", "[STUDENT]", r.text) for r in docs.collect()]
    assert ours == plain


def test_anonymize_with_recogniser(spark):
    import pandas as pd

    @F.pandas_udf("array<struct<start:int,end:int>>")
    def ner(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": m.start(), "end": m.end()} for m in re.finditer("alice|bob", t or "")])

    df = R.anonymize(texts(spark, "alice saw bob", "bobsled", "  "), ner=ner)
    assert values(df, "text") == ["[STUDENT] saw [STUDENT]", "[STUDENT]sled", "  "]


def test_noise(spark):
    kept = R.drop_noise(texts(spark, "short", "  a good long enough line  ", "id 123456 in a long enough line", "12345 !!! ??? 98 76 54 32", "x123456y is part of a word"))
    assert values(kept, "text") == ["a good long enough line", "x123456y is part of a word"]


@pytest.mark.parametrize("text, want", [
    ("Great teammate overall", C.PEER),
    ("I feel good about it", C.SELF),
    ("I did my part", C.SELF),                       # two overlapping phrases
    ("i am " + "word " * 27, C.SELF),                # 29 tokens
    ("i am " + "word " * 28, C.PEER),                # 30 tokens
    ("I feel that I worked " + "w " * 60, C.SELF),
    ("", C.PEER),
])
def test_subtype(spark, text, want):
    assert values(texts(spark, text).select(T.feedback_subtype(F.col("text")).alias("v"))) == [want]


LEXICON = {"A": ["race", "late night"], "B": ["visa", "esl"]}


def test_lexicon(spark):
    df = G.match_lexicon(texts(spark, "no TRACE left", "my Visa, late night", "plain", None), LEXICON)
    assert [(r.keyword_minority, r.keyword_categories) for r in df.collect()] == [(True, "A"), (True, "A|B"), (False, ""), (False, "")]
    alone = G.match_lexicon(texts(spark, "plain"), LEXICON, none_label=C.OUTLIER_ONLY)
    assert values(alone, "keyword_categories") == [C.OUTLIER_ONLY]


@pytest.mark.parametrize("size", [3, 300])
def test_lexicon_equals_a_search_per_phrase(spark, sf_dir, size):
    """Phrases that share parts, start alike, nest across categories and hold signs
    that mean something in a pattern."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text")
    odd = texts(spark, "a.b (c)", "axb c", "under\\score [x]", "tab\tend $5.00", "über straße", "no visa issue", "visas", "", None).select(
        (F.col("row_id") + 10 ** 6).alias("row_id"), "text")
    docs = docs.unionByName(odd)
    parts = [f"{a}{b}{c}" for a in ("er", "an", "th", "on", "le") for b in "aeious" for c in ("n", "r", "st", " t", ".\n", " d", "x", "z", "q", "k")]
    lexicon = {"A": parts[:size], "B": ["the", "that", "other than", "visa issue"], "C": ["the", "über", "zzz", "visa", ""],
               "D": ["a.b", "(c)", "[x]", "\\s", "$5", "b (", "\tend"], "E": []}
    found = {r.row_id: r.keyword_categories for r in G.match_lexicon(docs, lexicon).collect()}
    for r in docs.collect():
        low = (r.text or "").lower()
        assert found[r.row_id] == "|".join(c for c, ps in lexicon.items() if any(p and p in low for p in ps)), r.text
    assert len(set(found.values())) > 4
    plan = G.match_lexicon(docs, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shortest_phrases():
    assert X.shortest_phrases(["my child", "my children", "family", "my child"]) == ["my child", "family"]


def test_labels(spark):
    df = spark.createDataFrame([("5",), ("3.8",), ("3.79",), ("2.5",), ("2.4",), ("x",), (None,), ("NaN",)], "r string").coalesce(1)
    assert values(df.select(L.rating_to_sentiment(F.col("r")).alias("v"))) == [
        "Positive", "Positive", "Neutral", "Neutral", "Negative", None, None, None]
    assert values(df.select(L.quality_to_rating(F.col("r")).alias("v"))) == [1, 0, 0, -1, -1, None, -1, -1]
    assert values(df.select(L.quality_to_rating(F.col("r"), missing_is_low=False).alias("v")))[-3:] == [None, None, None]
    assert values(df.select(L.rating_bucket(F.col("r")).alias("v")))[-3:] == ["neutral"] * 3


def test_broad_and_coarse(spark):
    names = sorted({*C.PEER_LABELS, *C.SELF_LABELS, *C.PROFESSOR_LABELS, *C.COURSE_LABELS})
    df = spark.createDataFrame([(n,) for n in names], "l string").coalesce(1)
    got = {r.l: (r.b, r.c) for r in df.select("l", L.broad_sentiment(F.col("l")).alias("b"), L.coarse_polarity(F.col("l")).alias("c")).collect()}
    assert got["Teaching_Positive_Clarity"] == ("Positive", "Neutral")
    assert got["Negative_Attitude"] == ("Negative", "Negative")
    assert got["Self_Struggle"] == ("Negative", "Neutral") and got["Self_Suggestion"] == ("Neutral", "Neutral")
    assert got["Positive_Content"] == ("Positive", "Positive")


def test_mismatch(spark):
    df = spark.createDataFrame(
        [("Negative", 5.0), ("Positive", 1.0), ("Positive", 5.0), ("Positive", None), ("Neutral", 3.8)], "prediction string, rating double"
    ).coalesce(1)
    want = ["HIGH_MISMATCH", "REVERSE_MISMATCH", "", "", "HIGH_MISMATCH"]
    assert values(G.detect_mismatch(df, polarity="prefix"), "mismatch_type") == want
    assert not any(values(G.detect_mismatch(df, rating="no_such"), "mismatch_flag"))
    # An explicit zero threshold is honoured.
    assert values(G.detect_mismatch(df, high=0, polarity="prefix"), "mismatch_type")[4] == "HIGH_MISMATCH"


@pytest.mark.parametrize("label, flag, category, confidence, want", [
    ("Negative_Attitude", False, "", 0.9, 9), ("Self_Struggle", False, "", 0.9, 7),
    ("Majority_Positive", False, "", 0.9, 1), ("Self_Suggestion", False, "", 0.9, 5),
    ("Content_Negative_Outdated", False, "", 0.7999, 6), ("Self_Struggle", False, "", 0.80, 7),
    ("Majority_Positive", True, "Caregiver", 0.1, 10), ("Majority_Positive", True, C.OUTLIER_ONLY, 0.9, 1),
    ("Negative_Attitude", False, "", 0.5, 10), (None, False, None, 0.9, 5),
])
def test_priority(spark, label, flag, category, confidence, want):
    df = spark.createDataFrame([(label, flag, category, confidence)],
                               "prediction string, is_minority_pattern boolean, minority_category string, confidence double")
    assert values(G.add_priority(df), "priority_score") == [want]


def test_suppression_and_review(spark):
    df = spark.createDataFrame(
        [(True, "Caregiver", "Majority_Positive"), (False, C.OUTLIER_ONLY, "Majority_Positive"), (False, C.OUTLIER_ONLY, "Negative_Attitude")],
        "keyword_minority boolean, minority_category string, prediction string",
    ).withColumn("is_minority_pattern", F.lit(True)).coalesce(1)
    assert values(G.suppress_positive_outliers(df), "is_minority_pattern") == [True, False, True]
    conf = spark.createDataFrame([(0.649996,), (0.65,)], "confidence double").coalesce(1)
    rows = G.flag_review(conf).collect()
    assert [(r.needs_review, r.confidence) for r in rows] == [(True, 0.65), (False, 0.65)]
    assert values(G.flag_review(conf, threshold=0), "needs_review") == [False, False]


def test_melt(spark):
    df = spark.createDataFrame(
        [(1, 1, "long enough text", 0, "tiny"), (2, -1, None, 1, "  another good text ")],
        "row_id long, a long, a_text string, b long, b_text string",
    )
    pairs = [("a", "a_text", "a"), ("b", "b_text", "b")]
    rows = R.melt_dimensions(df, pairs, keep=("row_id",)).orderBy("row_id").collect()
    assert [(r.row_id, r.rating, r.dimension) for r in rows] == [(1, 1.0, "a"), (2, 1.0, "b")]
    assert R.melt_dimensions(df, pairs[:1]) is df


def test_mode(spark):
    assert R.feedback_mode_of(texts(spark, "The professor and the syllabus")) == C.S2P
    assert R.feedback_mode_of(texts(spark, "professor", "teammate")) == C.S2S
    assert R.feedback_mode_of(texts(spark)) == C.S2S
    late = texts(spark, *["nothing"] * 300, "professor exam lecture")
    assert R.feedback_mode_of(late.repartition(7)) == C.S2P
    assert R.feedback_mode_of(texts(spark, "exam", "my Team", "member was late").repartition(3)) == C.S2S


def test_mode_phrases_may_span_texts(spark):
    """Every phrase, also over several short texts, as in one joined string."""
    draw = random.Random(5)
    phrases = ["a b c d", "b b", "cc a", "long phrase here", "d", "a  b", "zz"]
    for n in (1, 2, 40, 400):
        rows = [draw.choice(["a", "b", "c", "d", "", "cc", "b a", "x long", "phrase", "here a", "a" * 40 + " b"]) for _ in range(n)]
        joined = " ".join(rows)
        for width in (1, 5):
            found = R.detect_feedback_mode(texts(spark, *rows).repartition(width), peer=phrases, professor=["b c", "none"]).first()
            assert found.peer_score == sum(p in joined for p in phrases)
            assert found.professor_score == ("b c" in joined)


def test_derive_labels(spark):
    rated = lambda *r: spark.createDataFrame([(None if x is None else float(x),) for x in r], "rating double").coalesce(1)
    assert values(labelling.derive_labels(rated(5, 1, 3, 3.5, 5), None, "rating"), "sentiment") == ["Positive", "Negative", "Neutral", "Neutral", "Positive"]
    constant = labelling.derive_labels(rated(5, 5, 5), None, "rating")
    assert values(constant, "sentiment") == ["Negative"] * 3
    assert values(labelling.derive_labels(rated(None, None), None, "rating"), "sentiment") == [None, None]
    spread = labelling.derive_labels(rated(4, 4.2, 4.4, 4.6, 4.8, 5), None, "rating")
    assert values(spread, "sentiment") == ["Negative", "Negative", "Neutral", "Neutral", "Positive", "Positive"]
    ternary = labelling.derive_labels(rated(-1, 0, 1), None, "rating", training=True)
    assert values(ternary, "sentiment") == ["Negative", "Neutral", "Positive"]
    with pytest.raises(ValueError):
        labelling.derive_labels(rated(1))


def test_category_breakdown(spark):
    df = spark.createDataFrame([("A|B",), ("A",), ("",), ("C",), (C.OUTLIER_ONLY,), (None,)], "minority_category string").withColumn("is_minority_pattern", F.lit(True))
    got = {r.category: r.n for r in A.category_breakdown(df).collect()}
    assert got == {"A": 2, "B": 1, "C": 1, C.OUTLIER_ONLY: 1}


def test_mixed_signals(spark):
    df = spark.createDataFrame([
        (1, "x", "Lab_Positive", False, ""), (2, "x", "Exam_Negative_Unfair", False, ""), (3, "x", "Exam_Negative_Unfair", True, "Caregiver"),
        (4, "y", "Lab_Positive", False, ""), (5, "z", "Exam_Negative_Unfair", True, C.OUTLIER_ONLY), (6, None, "Lab_Positive", False, ""),
        (7, None, "Exam_Negative_Unfair", False, ""), (8, "x", "Exam_Negative_Unfair", True, C.OUTLIER_ONLY),
    ], "row_id long, teacher string, prediction string, is_minority_pattern boolean, minority_category string")
    got = {r.row_id: (r.is_minority_pattern, r.minority_category) for r in N.mixed_signals(df).collect()}
    assert got == {
        1: (False, ""), 2: (True, C.MIXED_SIGNAL), 3: (True, C.MIXED_SIGNAL + "|Caregiver"), 4: (False, ""),
        5: (True, C.OUTLIER_ONLY), 6: (False, ""), 7: (False, ""), 8: (True, C.MIXED_SIGNAL),
    }
    assert N.mixed_signals(df.drop("teacher")).columns == df.drop("teacher").columns


def test_entity_findings(spark):
    def rows(entity, label, n):
        return [(entity, label, False, 5)] * n

    data = (
        rows("ten", "Exam_Negative_Unfair", 3) + rows("ten", "Lab_Positive", 27)            # exactly 10 %
        + rows("below", "Exam_Negative_Unfair", 3) + rows("below", "Lab_Positive", 28)      # below 10 %
        + rows("two", "Exam_Negative_Unfair", 2)                                            # too few
        + rows("both", "Exam_Negative_Unfair", 5) + rows("both", "Support_Negative_Equity", 3)  # high before medium
        + rows("both", None, 2)
    )
    df = spark.createDataFrame(data, "entity string, prediction string, is_minority_pattern boolean, priority_score int")
    got = {r.entity: r for r in N.aggregate_by_entity(df, "entity").collect()}
    assert [f.label for f in got["ten"].flagged_findings] == ["Exam_Negative_Unfair"] and got["ten"].needs_attention
    assert got["below"].flagged_findings == [] and got["two"].flagged_findings == []
    assert [f.label for f in got["both"].flagged_findings] == ["Exam_Negative_Unfair", "Support_Negative_Equity"]
    assert got["both"].top_negative_label == "Support_Negative_Equity"
    assert got["both"].total_responses == 10 and got["both"].label_counts == {"Exam_Negative_Unfair": 5, "Support_Negative_Equity": 3}
    text = {r.entity: r.flagged_findings_str for r in N.summary_strings(N.aggregate_by_entity(df, "entity")).collect()}
    assert text["both"] == "Exam_Negative_Unfair (5 students, 50.0%); Support_Negative_Equity (3 students, 30.0%)"


def test_entity_columns():
    assert R.signal_entity_column(["text", "name", "id"]) == "id"
    assert R.summary_entity_column(["text", "course_id", "dimension"]) == "course_id"
    assert R.summary_entity_column(["text", "dimension"]) == "dimension"
    assert R.summary_entity_column(["text"]) == "feedback_mode"


def test_zero_shot_cache_and_blank(spark, tmp_path):
    df = texts(spark, "lab equipment is broken", "the exam was unfair", "", "lab equipment is broken")
    path = str(tmp_path / "cache")
    first = Z.zero_shot_label(df, C.PROFESSOR_CANDIDATES, cache_path=path)
    got = {r.row_id: r.sentiment for r in first.collect()}
    assert got == {0: "Lab_Negative_Equipment", 1: "Exam_Negative_Unfair", 2: "", 3: "Lab_Negative_Equipment"}
    assert spark.read.parquet(path).count() == 3

    def other(text, candidates):
        return F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(len(candidates))])

    more = texts(spark, "lab equipment is broken", "something quite new")
    again = {r.row_id: r.sentiment for r in Z.zero_shot_label(more, C.PROFESSOR_CANDIDATES, other, path).collect()}
    assert again == {0: "Lab_Negative_Equipment", 1: "Teaching_Positive_Clarity"}  # first writer wins
    assert spark.read.parquet(path).count() == 4


def test_no_evidence_is_no_label(spark, tmp_path):
    """Neither a label nor a confidence, review instead, and nothing in the cache."""
    df = texts(spark, "lab equipment is broken", "xyzzy", "", None)
    got = {r.row_id: r for r in K.classify(df, **PL.DESCRIPTION_CLASSIFIERS[C.S2P]).collect()}
    assert got[0].prediction == "Lab_Negative_Equipment" and got[0].confidence > 0
    assert all((got[i].prediction, got[i].confidence, got[i].needs_review) == (None, None, True) for i in (1, 2, 3))
    path = str(tmp_path / "cache")
    labels = {r.row_id: r.sentiment for r in Z.zero_shot_label(df, C.PROFESSOR_CANDIDATES, cache_path=path).collect()}
    assert labels == {0: "Lab_Negative_Equipment", 1: None, 2: "", 3: ""}
    assert spark.read.parquet(path).count() == 2
    named = Z.zero_shot_label(df, C.PROFESSOR_CANDIDATES, default="Majority_Positive")
    assert {r.row_id: r.sentiment for r in named.collect()}[1] == "Majority_Positive"
    scored = {r.row_id: r for r in PL.score_texts(df, mode=C.S2S).collect()}
    assert (scored[1].prediction, scored[1].broad_sentiment, scored[1].priority_score) == (None, C.NEUTRAL, 5)
    multi = {r.row_id: r.categories for r in Z.zero_shot_multi(df).collect()}
    assert multi[1] == multi[3] == C.OUTLIER_ONLY


def test_first_label_decides_for_copies(spark):
    df = spark.createDataFrame([
        (1, "same text", "examination", 1.0), (2, "same text", "teaching", -1.0), (3, "Slides are hard to follow", "teaching", -1.0),
        (4, "anything", "parking", 0.0), (5, "good and relevant", "course_content", 1.0),
    ], "row_id long, text string, dimension string, rating double")
    got = {r.row_id: r.sentiment for r in Z.label_by_dimension(df).collect()}
    assert got[1] == got[2] == "Exam_Positive_Fair" and got[3] == "Teaching_Negative_Clarity" and got[4] == "Majority_Positive"
    assert got[5] == "Content_Positive_Relevance"
    strict = {r.row_id: r.sentiment for r in Z.label_by_dimension(df, strict_keys=True).collect()}
    assert strict[5] == "Majority_Positive"


def test_bands(spark):
    df = spark.createDataFrame([(0.9,), (0.7,), (0.69,), (None,)], "c double").coalesce(1)
    assert values(df.select(S.confidence_band(F.col("c")).alias("v"))) == ["high", "mid", "low", "low"]
