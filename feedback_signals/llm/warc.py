"""A deterministic, sharded WARC writer and its reader.

Records are put into ranges of ``page_id`` whose bounds come from the rows of least
hash, sorted within a range, and written by one task per range; a file is rolled
when its compressed size passes ``roll_bytes``.  Headers, record ids and digests are
derived from the row alone, so a task that runs again writes the same bytes.  A file
is written under a temporary name and renamed when complete; the tasks' lists of
files form a manifest table whose own commit makes the archive visible.  The reader
opens only what a manifest names and checks sizes and digests.

Of records whose payloads (UTF-8 of the html) are equal and of at least
``MIN_REVISIT`` bytes, the one with the smallest page_id is a response and the
others revisit it.  A null html is an empty payload.  Rows that repeat a page_id are
all written; a row that repeats the response's page_id is a response too.  A null
page_id sorts first and is always a response.  A null url is written as
``about:blank`` and read back as null.  An empty table gives an empty archive;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import Stages

MIN_REVISIT = 100
ROLL_BYTES = 256 << 20
RANGE_BYTES = 256 << 20
#: Smaller tables are written in up to this many ranges of at least so many bytes.
SPREAD, SPREAD_BYTES = 32, 8 << 20
#: Ids read to place the bounds of ranges; balance depends on it, results do not.
BOUND_ROWS = 10_000
SALTS = 16
DATE = "2020-01-01T00:00:00Z"
NOWHERE = "about:blank"
MANIFEST = "path string, shard int, roll int, records long, bytes long, sha256 string"
RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, payload binary, path string"
)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def render(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = NOWHERE if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Target-URI", target),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None and target != url:
        head.append(("X-Source-URI", url.encode("utf-8", "surrogatepass").hex()))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        head += [
            ("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-Profile", _PROFILE),
            ("X-Refers-To-Page-ID", str(refers_to)),
        ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in head)
    return b"WARC/1.1\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            head[name] = value
        size = int(head["Content-Length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("record is cut off")
        yield head, block


def _unpack(head: dict[str, str], block: bytes) -> dict:
    """A row of RECORD, with the record's digests checked."""
    if head["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"block digest of {head['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(h[16:]) for h in http.decode().split("\r\n") if h.startswith("Content-Length: "))
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload digest of {head['WARC-Record-ID']}")
    number = {k: int(head[h]) if h in head else None for k, h in (("page_id", "X-Page-ID"), ("refers_to", "X-Refers-To-Page-ID"))}
    url = bytes.fromhex(head["X-Source-URI"]).decode("utf-8", "surrogatepass") if "X-Source-URI" in head else head["WARC-Target-URI"]
    return {
        **number, "url": None if url == NOWHERE else url, "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "payload": payload if kind == "response" else None,
    }


class _Roll:
    """Files of one range, each renamed to its final name when it is full."""

    def __init__(self, folder: str, shard: int, roll_bytes: int):
        self.fs, self.base = pyarrow.fs.FileSystem.from_uri(folder)
        self.shard, self.limit, self.number, self.out = shard, roll_bytes, 0, None

    def add(self, record: bytes) -> dict | None:
        if self.out is None:
            self.name = f"range-{self.shard:06d}-{self.number:06d}.warc.gz"
            self.hidden = f"{self.base}/.{self.name}.{uuid.uuid4().hex}"
            self.out, self.sha = self.fs.open_output_stream(self.hidden, compression=None), hashlib.sha256()
            self.size = self.records = 0
        member = gzip.compress(record, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size, self.records = self.size + len(member), self.records + 1
        return self.close() if self.size >= self.limit else None

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.fs.move(self.hidden, f"{self.base}/{self.name}")
        row = {"path": self.name, "shard": self.shard, "roll": self.number, "records": self.records,
               "bytes": self.size, "sha256": self.sha.hexdigest()}
        self.out, self.number = None, self.number + 1
        return row


def _write_ranges(folder: str, roll_bytes: int):
    schema = pa.schema([("path", pa.string()), ("shard", pa.int32()), ("roll", pa.int32()), ("records", pa.int64()),
                        ("bytes", pa.int64()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, done, marks = None, [], (None, {})
        for batch in batches:
            for i in range(batch.num_rows):
                shard, page_id, url, html, digest, refers_to = (c[i].as_py() for c in batch.columns)
                if marks[0] != page_id:
                    marks = (page_id, {})
                if refers_to is not None:
                    marks[1][digest] = refers_to
                    continue
                if roll is None or roll.shard != shard:
                    if roll:
                        done.append(roll.close())
                    roll = _Roll(folder, shard, roll_bytes)
                done.append(roll.add(render(page_id, url, html.encode("utf-8", "surrogatepass"), digest, marks[1].get(digest))))
        if roll:
            done.append(roll.close())
        yield pa.RecordBatch.from_pylist([d for d in done if d], schema)

    return run


def revisits(pages: DataFrame) -> DataFrame:
    """``page_id, digest, refers_to`` of the revisits.  Only ids and digests are joined,
    salted, since one payload may be most of the table."""
    rows = pages.filter(
        (F.octet_length("html") >= MIN_REVISIT) & F.col("page_id").isNotNull()
    ).select("page_id", F.sha2("html", 256).alias("digest"))
    first = (
        rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return salted.join(first, ["digest", "salt"]).filter("refers_to < page_id").select("page_id", "digest", "refers_to").distinct()


def range_count(size: int, range_bytes: int = RANGE_BYTES) -> int:
    """How many ranges a table of ``size`` bytes is written in.  Nothing but the bytes
    counts, so every cluster writes the same files."""
    return max(1, -(-size // range_bytes), min(SPREAD, -(-size // SPREAD_BYTES)))


def write_archive(
    pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    roll_bytes: int = ROLL_BYTES, range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Write the archive into ``folder`` (a URI that all executors reach) and return
    its manifest, one row per file, which is also at ``<folder>/manifest``."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    )
    size, n = rows.agg(F.sum(F.octet_length("html").cast("long") + 400), F.count(F.lit(1))).first()
    ranges = range_count(size or 0, range_bytes)
    every = max(1, n // BOUND_ROWS)
    bounds = sorted(r[0] for r in rows.filter(
        (F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0) & F.col("page_id").isNotNull()
    ).select("page_id").orderBy(F.xxhash64("page_id", F.lit(1)), "page_id").limit(BOUND_ROWS).collect())
    cuts = sorted({bounds[len(bounds) * k // ranges] for k in range(1, ranges)}) if bounds else []

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series([0 if pd.isna(i) else bisect_right(cuts, int(i)) for i in ids], dtype="int32")

    pyarrow_fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    pyarrow_fs.create_dir(base, recursive=True)
    # marks of revisits travel to the page's range, ahead of the page: one shuffle of html
    marked = rows.withColumn("digest", F.sha2("html", 256)).withColumn("refers_to", F.lit(None).cast("long")).unionByName(
        revisits(rows), allowMissingColumns=True
    )
    ordered = marked.withColumn("shard", place(F.col("page_id"))).repartitionById(ranges, "shard").sortWithinPartitions(
        "shard", "page_id", F.col("refers_to").asc_nulls_last(), "digest", "url"
    ).select("shard", "page_id", "url", "html", "digest", "refers_to")
    ordered.mapInArrow(_write_ranges(folder, roll_bytes), MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_archive(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest names, checked; ``payload`` is null
    for revisits, and everywhere without ``payloads``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("path", pa.string()),
        ])
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, seen = [], 0, 0
                with fs.open_input_stream(f"{base}/{path}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in parse(stream):
                        row = _unpack(head, block) | {"path": path}
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held, seen = held + len(row["payload"] or b"") + 300, seen + 1
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{path} holds {seen} of {records} records")
                yield pa.RecordBatch.from_pylist(rows, schema)

    manifest = read_manifest(spark, folder).select("path", "records")
    return manifest.repartition(max(1, manifest.count()), "path").mapInArrow(run, RECORD)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages under the shared folder and read them back, without payloads."""
    spark = pages.sparkSession
    folder = Stages(spark).path(keep=True)
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    write_archive(pages, folder)
    return read_archive(spark, folder, payloads=False).drop("payload")
