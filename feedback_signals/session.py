"""Session helpers: a local session for tests, and lineage cuts that survive
the loss of an executor."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "feedback_signals", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on.  Memory, shuffle width and the
    checkpoint folder are the cluster's business and are left alone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise RuntimeError(
            "spark.checkpoint.dir is not set: name a folder that the driver and all executors share; "
            "intermediate tables are written there"
        )
    return shared.rstrip("/")


def name_folder(spark: SparkSession, make_folder: Callable[[], str]) -> None:
    """Give a session that names no shared folder one of its own.  Only a local
    master may do so: there the driver and the tasks are one process."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            scratch_folder(spark)  # raises
        spark.conf.set("spark.checkpoint.dir", make_folder())


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


#: Tasks a core of a stage that writes a table.
TASKS_PER_CORE = 4


def task_number(spark: SparkSession) -> int:
    return TASKS_PER_CORE * spark.sparkContext.defaultParallelism


@contextmanager
def even_tasks(spark: SparkSession) -> Iterator[None]:
    """Files and shuffled rows are read by several tasks a core.  By default Spark aims at
    one a core and often makes a few more, so that most cores wait for a second round."""
    keys = ("spark.sql.files.minPartitionNum", "spark.sql.adaptive.coalescePartitions.minPartitionNum")
    before = {key: spark.conf.get(key, None) for key in keys}
    try:
        for key in keys:
            if before[key] is None:
                spark.conf.set(key, str(task_number(spark)))
        yield
    finally:
        for key in keys:
            if before[key] is None:
                spark.conf.unset(key)


class Stages:
    """The intermediate tables of one run.

    ``write`` stores a table in the shared folder and reads it back: lineage is
    cut, lost executors cost nothing, and later reads take only the columns they
    need.  ``drop`` deletes a table that nothing reads any more; ``close`` (or
    leaving the ``with`` block) deletes all that are left.  What a returned lazy
    result still reads is written with ``keep=True`` and deleted when the
    application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._held: dict[int, tuple[DataFrame, str]] = {}

    def path(self, keep: bool = False) -> str:
        path = f"{scratch_folder(self.spark)}/stages/{uuid.uuid4().hex}"
        if keep:
            system, target = _file_system(self.spark, path)
            system.deleteOnExit(target)
        return path

    def write(self, df: DataFrame, keep: bool = False) -> DataFrame:
        path = self.path(keep)
        with even_tasks(self.spark):
            df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        if not keep:
            self._held[id(back)] = (back, path)
        return back

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self._held.pop(id(table), (None, None))
            if path:
                system, target = _file_system(self.spark, path)
                system.delete(target, True)

    def close(self) -> None:
        self.drop(*[table for table, _ in list(self._held.values())])

    def __enter__(self) -> "Stages":
        return self

    def __exit__(self, *_) -> None:
        self.close()


def materialize(df: DataFrame) -> DataFrame:
    """``Stages.write`` for a table whose reader is the caller's lazy result: it
    stays until the application ends."""
    return Stages(df.sparkSession).write(df, keep=True)


def spread_small(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Use all cores for heavy row-wise work on a table read in fewer splits
    than there are cores.  A table with enough splits is left as it is, so a
    large one is never shuffled for this; neither is one that a shuffle already
    spreads, whose stages would have to run first to be counted."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if re.search(r"(?<!Broadcast)Exchange", plan):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
