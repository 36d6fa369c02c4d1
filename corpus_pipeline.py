"""A corpus in five stages, each one a table in the shared folder.

Toxic documents go, one row of each group of equal texts stays, one document of each
component of near copies stays, documents that overlap the benchmark go, and what is left
is encoded and decoded.  Every stage but the last returns the columns it was given,
and decides on all rows it was given.  Null columns, null, empty and repeated rows
and empty tables pass as the operators define; null and empty texts are equal to
each other, so one of them stays.  A row without a doc_id is judged by its text in
the toxicity stage and leaves in the exact one, since no verdict can name it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedback_signals.llm import byte_bpe, decontaminate, exact_dedup, simhash, toxicity
from feedback_signals.session import Stages


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_scores(docs, model, "text", "_toxicity_")
    return scored.filter(F.col("_toxicity_score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest doc_id of each group of equal texts."""
    kept = exact_dedup.extendible_dedup(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("_sha")).distinct()
    marked = docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    # a row that repeats id and text is one row; both steps share one shuffle
    return marked.join(kept, ["doc_id", "_sha"], "left_semi").dropDuplicates(["doc_id", "_sha"]).select(*docs.columns)


def _named(docs: DataFrame) -> DataFrame:
    """Documents with ``_row``, their id and the digest of their text: a verdict names
    a text, so that different texts under one id are judged apart."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return docs.withColumn("_row", F.struct(F.col("doc_id"), digest.alias("digest")))


def _without(docs: DataFrame, named: DataFrame, dropped: DataFrame) -> DataFrame:
    return named.join(dropped, "_row", "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each component of near copies, linked by the
    near-duplicate operator at three-word shingles and three of 64 bits."""
    named = _named(docs)
    found = simhash.near_duplicates(named, doc_id="_row")
    return _without(docs, named, found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_row")).distinct())


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    named = _named(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.contaminated(named, benchmark, doc_id="_row")
    return _without(docs, named, found.select(F.col("doc_id").alias("_row")).distinct())


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of the decoded bytes."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level BPE", tokenize),
]
#: Scores, fingerprints and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stages = spark.read.parquet(f"{sf_dir}/documents.parquet"), Stages(spark)
    for _, stage in STAGES:
        docs = stages.write(stage(spark, docs, sf_dir), keep=True)
    return docs
