"""Exact deduplication over an extendible-hash index.

A directory of ``2**depth`` slots maps the leading bits of a text's hash to a
bucket.  It starts with one bucket and doubles while a bucket holds more bytes
than ``capacity``.  The index is a table of files in the shared folder, one
folder per bucket; each bucket is a key range that one owner task writes.  Equal
texts meet in a grouping whose key is the text, so bytes are compared there and
copies collapse before the shuffle: a group holding a third of all rows crosses
the network once per map task.  Different texts under one hash are chained in the
bucket with their SHA-256 and number in the chain, and rows find their entry by
hash and digest.

Rows: a null text counts as empty; rows that repeat an id with the same text are
all returned and all carry the same verdict; an empty table gives an empty result;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Stages

CAPACITY_BYTES = 64 << 20
#: Slots of the directory are at most 2**MAX_DEPTH, so it has a bounded size.
MAX_DEPTH = 16


def _slot(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth).cast("int") if depth else F.lit(0)


def grow_directory(sizes: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[int]:
    """Bucket of each slot.  ``sizes`` holds the bytes per slot at ``max_depth``;
    the result has ``2**depth`` entries for the least depth at which every bucket
    fits (or cannot be split further)."""
    held = [0] * (1 << max_depth)
    for slot, size in sizes.items():
        held[slot] = size
    sums = [0]
    for size in held:
        sums.append(sums[-1] + size)

    def load(prefix: int, depth: int) -> int:
        width = max_depth - depth
        return sums[(prefix + 1) << width] - sums[prefix << width]

    directory, buckets, depth = [0], [(0, 0)], 0  # a bucket is (prefix, local depth)
    while True:
        overfull = {i for i, (p, d) in enumerate(buckets) if d < max_depth and load(p, d) > capacity}
        if not overfull:
            return directory
        if any(buckets[i][1] == depth for i in overfull):
            directory = [bucket for bucket in directory for _ in (0, 1)]
            depth += 1
        for i in overfull:
            prefix, local = buckets[i]
            buckets[i] = (prefix * 2, local + 1)
            buckets.append((prefix * 2 + 1, local + 1))
            width = depth - local - 1
            for slot in range((prefix * 2 + 1) << width, (prefix * 2 + 2) << width):
                directory[slot] = len(buckets) - 1


def _bucket(key: Column, directory: list[int]) -> Column:
    entries = F.from_json(F.lit(json.dumps(directory)), "array<int>")
    return F.element_at(entries, _slot(key, (len(directory) - 1).bit_length()) + 1)


def extendible_dedup(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    capacity: int = CAPACITY_BYTES,
    max_depth: int = MAX_DEPTH,
    hash_key: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, bucket, chain`` for every
    row; of equal texts the row with the largest ``doc_id`` is kept."""
    whole = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).withColumn("key", hash_key(F.col("text")))
    sizes = {
        row["slot"]: row["size"]
        for row in whole.groupBy(_slot(F.col("key"), max_depth).alias("slot"))
        .agg(F.sum(F.octet_length("text") + 1).alias("size")).collect()
    }
    directory = grow_directory(sizes, capacity, max_depth)
    stages = Stages(docs.sparkSession)
    groups = whole.groupBy("key", "text").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    entries = groups.select(
        _bucket(F.col("key"), directory).alias("bucket"), "key", F.sha2("text", 256).alias("text_sha256"),
        "keep_id", "group_size",
    )
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("text_sha256"))
    owned = entries.repartition("bucket").withColumn("chain", chain)
    path = stages.path(keep=True)
    owned.write.partitionBy("bucket").parquet(path)
    schema = owned.select("key", "text_sha256", "keep_id", "group_size", "chain", "bucket").schema
    index = docs.sparkSession.read.schema(schema).parquet(path)
    rows = whole.select("doc_id", "key", F.sha2("text", 256).alias("text_sha256"))
    return rows.join(index, ["key", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256",
        "bucket", "chain",
    )
