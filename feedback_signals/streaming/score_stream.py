"""Unattended scoring: files arrive, are scored, and results are published."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import signals as G
from ..operators.aggregates import count_if
from ..operators.reshape import anonymize, drop_short
from ..plans.pipeline import Options, finish_rows, score_rows


def score_batch(df: DataFrame, mode: str, options: Options) -> DataFrame:
    """The row-wise stages, which give the same result on a stream and on a
    table: no detector and no entity-wide flags."""
    rows = drop_short(df, options.settings.min_chars)
    if options.anonymize:
        rows = anonymize(rows, placeholder=options.settings.placeholder, ner=options.ner)
    rows = G.merge_minority_flags(score_rows(rows, mode, options), embedding=False)
    rating = "rating" if "rating" in df.columns else None
    row_wise = replace(options.settings, mixed_signal_detection=False)
    return finish_rows(rows, replace(options, settings=row_wise), rating)


def label_parts(df: DataFrame) -> DataFrame:
    """Additive per-label parts of a batch; sums of them give label statistics."""
    return df.groupBy("prediction").agg(
        F.count("*").alias("n"),
        F.sum("confidence").alias("confidence_sum"),
        count_if(F.col("is_minority_pattern")).alias("minority"),
    )


def score_stream(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    schema: str,
    mode: str,
    options: Options,
    checkpoint_dir: str,
    files_per_batch: int = 64,
    file_format: str = "parquet",
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Score every file that appears in ``in_dir``.  A batch overwrites its own
    folder, so a batch that is run again after a failure leaves no duplicates.

    ``trigger`` holds the arguments of ``DataStreamWriter.trigger``; by default what
    lies there is scored and the query ends, ``{"processingTime": "1 minute"}`` goes on
    until it is stopped.  A query started again on the same folders goes on where the
    one before stopped, whatever the triggers of the two."""
    source = (
        spark.readStream.schema(schema).format(file_format)
        .option("maxFilesPerTrigger", files_per_batch).load(in_dir)
    )
    scored = score_batch(source, mode, options)

    def publish(batch: DataFrame, batch_id: int) -> None:
        rows = f"{out_dir}/rows/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(rows)
        stored = batch.sparkSession.read.parquet(rows)
        label_parts(stored).write.mode("overwrite").parquet(f"{out_dir}/label_parts/batch_id={batch_id}")

    return (
        scored.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """Label statistics over all batches so far; like ``label_stats`` without the rows
    that have no label."""
    parts = spark.read.parquet(f"{out_dir}/label_parts").filter(F.col("prediction").isNotNull())
    return parts.groupBy(F.col("prediction").alias("label")).agg(
        F.sum("n").alias("count"),
        (F.sum("confidence_sum") / F.sum("n")).alias("avg_confidence"),
        F.sum("minority").alias("minority_count"),
    )
