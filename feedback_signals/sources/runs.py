"""The log of finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def latest_runs(log: DataFrame, k: int = 20, search: str = "") -> DataFrame:
    """The newest entry of each run, newest first, at most ``k``; ``search``
    looks in the file name and the mode of those."""
    # An aggregate keeps one entry per run before the shuffle.
    columns = [c for c in log.columns if c != "run_id"]
    newest = log.groupBy("run_id").agg(
        F.max_by(F.struct(*columns), F.struct("finished_at", *[c for c in columns if c != "finished_at"])).alias("r")
    ).select("run_id", "r.*")
    listed = newest.orderBy(F.desc("finished_at"), "run_id").limit(k)
    if not search:
        return listed
    has = lambda c: F.contains(F.lower(c), F.lit(search.lower()))
    return listed.filter(has("filename") | has("mode"))


def append_run(log_path: str, entry: DataFrame) -> None:
    entry.write.mode("append").parquet(log_path)
