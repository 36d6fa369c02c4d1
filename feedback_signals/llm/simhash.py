"""SimHash near-duplicates by multi-index hashing.

A document's fingerprint has the bits that over half of the XXH64 values of its
three-word shingles have.  Fingerprints are linked at ``RADIUS`` = 3 or fewer
differing bits.  A fingerprint has two segments of 32 bits; of three differing bits
at most one falls into one of the segments, so for either segment the ball of
radius one around its value is enumerated, the table of fingerprints is read at
those values, and what is found there is verified on all 64 bits.  Of two values
that differ in one bit only the one that has it set probes the other: half of the
ball suffices to meet every pair once.

Copies cost nothing: equal fingerprints are one row.  A bucket that more than
``BUCKET`` fingerprints share is dealt out once more by the balls of the other
segment's 16-bit parts, so no bucket depends on the size of the corpus (its rows
agree in 47 of 64 bits and are distinct).  A bucket yields a spanning forest of
its links, never all pairs.

Null and empty texts, and texts of white space, have fingerprint zero and are
linked like any other; a text of one or two words is one shingle.  Rows that repeat
an id are returned as they are.  An empty table gives an empty result; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from ..session import Stages
from .components import components

RADIUS = 3
SEED = 42
#: Fingerprints at one value of a segment; a bucket above this is dealt out again.
BUCKET = 4096
#: Buckets up to this size are compared by shifting the sorted rows.
SMALL = 16
_HASHES = 1 << 16


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        shingles, n = [b" ".join(words)], 1
    else:
        shingles, n = map(b" ".join, zip(words, words[1:], words[2:])), len(words) - 2
    hashes = map(xxh64_intdigest, shingles, repeat(SEED))
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, _HASHES):
        block = np.fromiter(hashes, dtype="<u8", count=min(_HASHES, n - start))
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, fp``: the 64 bits as a signed long."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, fp long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _half(fp: Column, segment: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if segment else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _ball(value: Column, bits: int) -> Column:
    """The value and each value with one of its set bits cleared."""
    return F.explode(F.filter(
        F.array(F.lit(0).cast("long"), *[value.bitwiseAND(F.lit(1 << i)) for i in range(bits)]),
        lambda mask, i: (i == 0) | (mask != 0),
    ))


def _probes(fps: DataFrame) -> DataFrame:
    """``bucket, part, fp``: bucket is the segment's number and a value in its ball."""
    rows = None
    for segment in (0, 1):
        half = _half(F.col("fp"), segment)
        one = fps.select("fp", half.alias("half")).select("fp", "half", _ball(F.col("half"), 32).alias("mask")).select(
            (F.col("half").bitwiseXOR(F.col("mask")) + F.lit(segment << 32)).alias("bucket"), "fp"
        )
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _deal_again(rows: DataFrame) -> DataFrame:
    """Rows of a full bucket by the balls of the other segment's two parts."""
    other = F.when(F.shiftrightunsigned("bucket", 32) == 0, _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0))
    parts = None
    for number in (0, 1):
        part = F.shiftrightunsigned(other, 16) if number else other.bitwiseAND(F.lit(0xFFFF))
        one = rows.select("bucket", "fp", part.alias("value")).select("bucket", "fp", "value", _ball(F.col("value"), 16).alias("mask")).select(
            "bucket", (F.col("value").bitwiseXOR(F.col("mask")) + F.lit(number << 16)).alias("part"), "fp"
        )
        parts = one if parts is None else parts.unionByName(one)
    return parts


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= RADIUS


def _forest(fp: np.ndarray, home: np.ndarray, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links of a bucket, breadth first.  A link has an end
    that is at home in the bucket."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:step], front[step:]
            linked = np.zeros(len(left), dtype=bool)
            parent = np.zeros(len(left), dtype=np.int64)
            for begin in range(0, len(left), 1 << 14):
                cut = slice(begin, begin + (1 << 14))
                near = _near(fp[now][:, None], fp[left[cut]][None, :]) & (home[now][:, None] | home[left[cut]][None, :])
                linked[cut] = near.any(axis=0)
                parent[cut] = now[near.argmax(axis=0)]
            a.append(fp[parent[linked]])
            b.append(fp[left[linked]])
            front = np.concatenate([front, left[linked]])
            left = left[~linked]
    join = lambda parts: np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    return join(a), join(b)


def _bucket_links(bucket: np.ndarray, part: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets; rows are sorted by (bucket, part)."""
    segment, value = bucket >> 32, bucket & 0xFFFFFFFF
    home = np.where(segment == 0, fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32)).astype(np.int64) == value
    starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
    sizes = np.diff(np.r_[starts, len(bucket)])
    group = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    a, b = [], []
    for shift in range(1, min(SMALL, len(fp))):
        same = (group[shift:] == group[:-shift]) & small[shift:] & (home[shift:] | home[:-shift])
        at = np.flatnonzero(same)
        at = at[_near(fp[at], fp[at + shift])]
        a.append(fp[at])
        b.append(fp[at + shift])
    for k in np.flatnonzero(sizes > SMALL):
        cut = slice(starts[k], starts[k] + sizes[k])
        x, y = _forest(fp[cut], home[cut])
        a.append(x)
        b.append(y)
    if not a:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
    return np.concatenate(a), np.concatenate(b)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets of sorted rows; the last one of a batch waits for the next batch."""
    def links(columns):
        a, b = _bucket_links(columns[0], columns[1], columns[2].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held: list = []
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        if not len(now[0]):
            continue
        last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        cut = int(np.flatnonzero(last)[0])
        if held and (held[-1][0][-1], held[-1][1][-1]) == (now[0][0], now[1][0]) and cut == 0:
            held.append(now)  # one bucket over several batches
            continue
        done = [np.concatenate([h[i] for h in held] + [now[i][:cut]]) for i in range(3)]
        if len(done[0]):
            yield links(done)
        held = [[c[cut:] for c in now]]
    if held:
        yield links([np.concatenate([h[i] for h in held]) for i in range(3)])


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links that connect whatever distinct fingerprints (column ``fp``)
    within the radius connect."""
    probes = _probes(fps)
    at_home = None
    for segment in (0, 1):
        one = fps.select((_half(F.col("fp"), segment) + F.lit(segment << 32)).alias("bucket"))
        at_home = one if at_home is None else at_home.unionByName(one)
    full = at_home.groupBy("bucket").count().filter(F.col("count") > bucket).select("bucket")
    none = F.lit(-1).cast("long").alias("part")
    if full.isEmpty():
        rows = probes.select("bucket", none, "fp")
    else:
        rows = probes.join(full, "bucket", "left_anti").select("bucket", none, "fp").unionByName(
            _deal_again(probes.join(full, "bucket", "left_semi"))
        )
    return rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_verify, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row."""
    stages = Stages(docs.sparkSession)
    prints = stages.write(fingerprints(docs, text, doc_id), keep=True)
    fps = stages.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps, bucket))
    own = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = own.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stages.write(own.join(least, "root").select("fp", "component_id"), keep=True)
    stages.close()
    return prints.join(classes, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")
