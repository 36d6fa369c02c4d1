"""Headline queries, timed: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the width.  Every query is run once to warm up and then timed with
its full result written to a sink that discards it.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from feedback_signals.catalog import QUERIES
from feedback_signals.session import build_session

HEADLINE = (
    # row-wise chain
    "match_lexicon", "match_large_lexicon", "anonymize", "drop_noise", "feedback_subtype", "classify", "priority_score", "detect_mismatch",
    # aggregates, entities and joins
    "label_stats", "run_summary", "aggregate_by_entity", "mixed_signals", "category_breakdown",
    "classification_report", "first_label_per_text", "apply_label_cache",
    # samples and top-k
    "stratified_split", "undersample", "priority_alerts", "mismatch_view",
    # vectors
    "nearest_neighbor", "eps_neighbors", "dbscan", "dbscan_sampled", "isolation_outliers",
    # jobs
    "rate_cap", "detect_minority", "run_course_scoring",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="checkpoints-"), "spark.driver.bindAddress": "127.0.0.1",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spent = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent[name] = round(time.perf_counter() - start, 3)
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(spent.values()), 3), "unit": "sec",
        "queries": spent, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "documents": documents,
        "rows_per_sec": {q: round(documents / spent[q]) for q in ("match_lexicon", "classify", "run_course_scoring")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
