from pyspark.sql import functions as F

import corpus_pipeline
from feedback_signals.llm import decontaminate, simhash, toxicity

from . import fixtures


def _least_of_component(texts: dict) -> dict:
    """Smallest id reachable over links of three or fewer of 64 bits."""
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    group = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS and group[a] > group[b]:
                    group[a], changed = group[b], True
    return group


def test_each_stage_equals_its_decisions_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = {i: t for i, t in texts.items() if model.score(model.evidence(*model.scan(t))) < toxicity.THRESHOLD}
    last = {}
    for i, t in kept.items():
        last[t] = max(last.get(t, i), i)
    kept = {i: t for i, t in kept.items() if last[t] == i}
    group = _least_of_component(kept)
    kept = {i: t for i, t in kept.items() if group[i] == i}
    left = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    bad = {r[0] for r in decontaminate.contaminated(left, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").collect()}
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(set(kept) - bad)
    assert len(found) > len(texts) / 3


def test_near_dedup_stage_keeps_the_least_of_each_component(spark, sf_dir):
    texts = {i: t or "" for i, t in enumerate(fixtures.texts())}
    group = _least_of_component(texts)
    out = corpus_pipeline.drop_near_copies(spark, fixtures.table(spark), sf_dir)
    assert {r["doc_id"] for r in out.collect()} == {i for i in texts if group[i] == i}


def test_different_texts_under_one_id_are_judged_apart(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    near, other, alone = fixtures.words(300, 71), fixtures.words(300, 72), fixtures.words(300, 73)
    docs = spark.createDataFrame([(1, near), (2, near), (2, other), (3, alone), (3, item)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir)
    assert {tuple(r) for r in kept.collect()} == {(1, near), (2, other), (3, alone), (3, item)}
    clean = corpus_pipeline.drop_benchmark(spark, kept, sf_dir)
    assert {tuple(r) for r in clean.collect()} == {(1, near), (2, other), (3, alone)}


def test_stages_keep_columns_and_survive_odd_rows(spark, sf_dir):
    for docs in (fixtures.table(spark), fixtures.empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns, name
            out.collect()
    rows = corpus_pipeline.drop_copies(spark, fixtures.table(spark), sf_dir)
    assert rows.count() == rows.select(F.coalesce("text", F.lit(""))).distinct().count()
