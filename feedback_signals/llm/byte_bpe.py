"""Byte-level BPE encoding and decoding.

Texts are split by a pattern into pre-tokens, and the bytes of each are merged by
the ranks of a vocabulary file.  A long text is cut into overlapping chunks that are
pre-tokenised in parallel, each from its own start.  What a match looks like depends
on nothing before it, so two neighbouring chunks agree from the first place in their
overlap at which both have a boundary; there they are stitched, and the pieces
between stitches are encoded in parallel.  If an overlap has no common boundary (one
pre-token is longer than it), the earlier chunk is continued until one appears.
Decoding concatenates the bytes of the ids.

Null counts as empty; an empty text has no ids.  Rows that repeat an id are encoded
as they are.  An empty table gives an empty result; further columns are ignored,
whatever their names.  ``vocabulary`` is a path that every executor can read; it is
read once per Python worker.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

CHUNK = 1 << 15
OVERLAP = 512
#: A match may look this far beyond its end.
AHEAD = 4
_CACHE = 100_000
_IDS_PER_BATCH = 1 << 17
#: Characters whose pre-tokens are looked up together.
_TOGETHER = 1 << 18
_NEVER = 1 << 40


@lru_cache(maxsize=4)
def load_ranks(vocabulary: str) -> dict[bytes, int]:
    with open(vocabulary, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def _tokens(vocabulary: str) -> pa.LargeBinaryArray:
    """The bytes of every id at its position; null where the vocabulary has none."""
    by_rank = {rank: token for token, rank in load_ranks(vocabulary).items()}
    return pa.array(map(by_rank.get, range(max(by_rank, default=-1) + 1)), pa.large_binary())


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges with a heap: n log n for pre-tokens of any length."""
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))

    def pair(i):
        j = after[i]
        return ranks.get(piece[i : end[j]]) if j < n else None

    heap = [(rank, i, 2) for i in range(n - 1) if (rank := pair(i)) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        rank, i, length = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] - i != length or ranks.get(piece[i : end[j]]) != rank:
            continue  # out of date
        alive[j] = False
        end[i], after[i] = end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        for k in (i, before[i]):
            if k >= 0 and (rank := pair(k)) is not None:
                heapq.heappush(heap, (rank, k, end[after[k]] - k))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank is merged, leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 64:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
    while pairs:
        least = min(pairs)
        if least == 1 << 60:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
    return [ranks[p] for p in parts]


class _Pairs:
    """Which two neighbours merge into what: a sorted array of (left, right) ids, and
    beside it the ids of their concatenations."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [
            (left << 32 | right, rank)
            for token, rank in ranks.items() for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        table = np.array(sorted(found), np.int64).reshape(-1, 2)
        self.keys = np.append(table[:, 0], np.iinfo(np.int64).max)
        self.merged = np.append(table[:, 1], _NEVER)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.merged[at], _NEVER)

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many pre-tokens by the rule of ``merge``: in a round each makes
        its merge of least rank, leftmost first; one without any is finished."""
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), np.fromiter(map(len, pieces), np.int64, len(pieces)))
        rank = np.full(len(ids), _NEVER)  # of a symbol and its right neighbour
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self(ids[inner], ids[inner + 1])
        owners, finished = [], []
        while len(ids):
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, begin)
            least = np.repeat(least, np.diff(begin, append=len(ids)))
            open_ = least < _NEVER
            owners.append(owner[~open_])
            finished.append(ids[~open_])
            ids, owner, rank, least = ids[open_], owner[open_], rank[open_], least[open_]
            hits = np.flatnonzero(rank == least)
            hits = hits[np.diff(owner[hits], prepend=-1) != 0]
            ids[hits] = rank[hits]
            keep = np.ones(len(ids), bool)
            keep[hits + 1] = False
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            hits -= np.arange(len(hits))  # every pre-token before lost one symbol
            touched = np.concatenate([hits, hits[hits > 0] - 1])
            rank[touched] = _NEVER
            touched = touched[touched + 1 < len(ids)]
            touched = touched[owner[touched] == owner[touched + 1]]
            rank[touched] = self(ids[touched], ids[touched + 1])
        owner = np.concatenate([*owners, np.empty(0, np.int64)])
        order = np.argsort(owner, kind="stable")
        packed = np.concatenate([*finished, np.empty(0, np.int64)])[order].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(pieces)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]


class _Encoder:
    """Texts to ids, packed as 32-bit numbers.  The ids of pre-tokens are remembered in
    two generations, so that frequent ones outlive a full cache."""

    def __init__(self, vocabulary: str, pattern: str):
        self.ranks, self.split = load_ranks(vocabulary), regex.compile(pattern).findall
        self.pairs = _Pairs(self.ranks)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, tokens: set[str]) -> None:
        if len(self.known) > _CACHE:
            self.known, self.old = {}, self.known
        short = {}
        for token in tokens - self.known.keys():
            ids = self.old.get(token)
            if ids is None:
                piece = token.encode("utf-8", "surrogatepass")
                if piece not in self.ranks and len(piece) <= 64:
                    short[token] = piece
                    continue
                ids = array("i", merge(piece, self.ranks)).tobytes()
            self.known[token] = ids
        self.known.update(zip(short, self.pairs.merge_all(list(short.values()))))

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [self.split(text) for text in texts]
        self._learn(set().union(*split))
        ids = self.known.__getitem__
        return [b"".join(map(ids, tokens)) for tokens in split]


@lru_cache(maxsize=4)
def _encoder(vocabulary: str, pattern: str) -> _Encoder:
    return _Encoder(vocabulary, pattern)


def _encode_column(vocabulary: str, pattern: str, at: int, names: list[str]):
    """Ids of the texts in column ``at``, put in its place; output batches are small."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary, pattern)
        for batch in batches:
            begin, texts, size = 0, [], 0
            for row, text in enumerate(batch.column(at)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if size > _TOGETHER or row + 1 == batch.num_rows:
                    packed = encode(texts)
                    ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
                    ids = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(packed))])
                    columns = [c.slice(begin, len(texts)) for c in batch.columns]
                    columns[at] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)
                    yield pa.RecordBatch.from_arrays(columns, names)
                    begin, texts, size = row + 1, [], 0
    return run


def _chunks(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                for number, begin in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([sha.as_py()]), pa.array([number], pa.int32()),
                        pa.array([text[begin : begin + chunk + overlap]]), pa.array([begin + chunk + overlap >= len(text)]),
                    ], ["sha", "number", "chunk", "last"])
    return run


def _boundaries(split: regex.Pattern, text: str, begin: int, low: int, high: int) -> list[int]:
    """Starts of matches from ``begin`` on that lie in low .. high."""
    out = []
    for match in split.finditer(text, begin):
        if match.start() > high:
            break
        if match.start() >= low:
            out.append(match.start())
    return out


def _edges(pattern: str, chunk: int, overlap: int):
    """The boundaries of a chunk within its first and last ``overlap`` characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for text in batch.column(2):
                text = text.as_py()
                heads.append(_boundaries(split, text, 0, 0, overlap))
                tails.append(_boundaries(split, text, 0, chunk, len(text) - AHEAD))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))],
                ["sha", "number", "chunk", "last", "heads", "tails"],
            )
    return run


def stitch(chunks: list[str], heads: list[list[int]], tails: list[list[int]], pattern: str, chunk: int) -> list[str]:
    """Pieces of a text that are pre-tokenised alike alone and in their place.

    Where an overlap has no common boundary, one walk over the matches of the text goes on
    from the last stitch, through all further chunks until one agrees: linear for a
    pre-token of any length."""
    split = regex.compile(pattern)
    text = "".join([*(c[:chunk] for c in chunks[:-1]), chunks[-1]])
    pieces, start, first, walk, at = [], 0, 0, None, None  # walk: from ``start``, now at ``at``
    for k in range(1, len(chunks)):
        base = k * chunk
        common = {base + h for h in heads[k]}
        meet = None
        if walk is None:
            known = (first * chunk + t for t in tails[first])
            meet = next((t for t in known if t >= start and t in common), None)
            if meet is None:
                walk = (match.start() for match in split.finditer(text, start))
                at = next(walk, None)
        else:
            last = max(common, default=-1)
            while at is not None and at <= last and at not in common:
                at = next(walk, None)
            meet = at if at in common else None
        if meet is not None:
            pieces.append(text[start:meet])
            start, first, walk = meet, k, None
    return [p for p in (*pieces, text[start:]) if p]


def _stitched(pattern: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, parts in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts = parts.as_py()
                pieces = stitch(
                    [p["chunk"] for p in parts], [p["heads"] for p in parts], [p["tails"] for p in parts], pattern, chunk
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([sha] * len(pieces)), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.string())],
                    ["sha", "number", "piece"],
                )
    return run


def encode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    text: str = "text",
    doc_id: str = "doc_id",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``doc_id, ids`` for every row."""
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = rows.filter(F.length("text") <= chunk).mapInArrow(
        _encode_column(vocabulary, pattern, 1, ["doc_id", "ids"]), f"doc_id {kind}, ids array<int>"
    )
    long = rows.filter(F.length("text") > chunk).withColumn("sha", F.sha2("text", 256))
    parts = (
        long.select("sha", "text").dropDuplicates(["sha"])
        .mapInArrow(_chunks(chunk, overlap), "sha string, number int, chunk string, last boolean")
        # the last chunks may repeat the end of the text only
        .repartition("sha", "number")
        .mapInArrow(_edges(pattern, chunk, overlap),
                    "sha string, number int, chunk string, last boolean, heads array<int>, tails array<int>")
    )
    pieces = (
        parts.groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("number", "chunk", "heads", "tails"))).alias("parts"))
        .mapInArrow(_stitched(pattern, chunk), "sha string, number int, piece string")
        .repartition("sha", "number")
        .mapInArrow(_encode_column(vocabulary, pattern, 2, ["sha", "number", "ids"]), "sha string, number int, ids array<int>")
    )
    whole = pieces.groupBy("sha").agg(F.sort_array(F.collect_list(F.struct("number", "ids"))).alias("parts")).select(
        "sha", F.flatten(F.col("parts.ids")).alias("ids")
    )
    return short.unionByName(long.select("doc_id", "sha").join(whole, "sha").select("doc_id", "ids"))


def _few_ids(batches: Iterator[pa.RecordBatch], ids: str) -> Iterator[pa.RecordBatch]:
    """The batches in cuts of about ``_IDS_PER_BATCH`` ids; a row is never cut."""
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False)
        ends, begin = np.cumsum(lengths, dtype=np.int64), 0
        while begin < batch.num_rows:
            held = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, held + _IDS_PER_BATCH, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _decoded(ids: pa.ListArray, tokens: pa.LargeBinaryArray) -> list[memoryview | None]:
    """The bytes of every row of ids, cut from one buffer in which the tokens of all
    rows follow each other; an id outside the vocabulary is an error."""
    taken = tokens.take(ids.flatten())
    if taken.null_count:
        raise KeyError("an id that the vocabulary does not have")
    _, offsets, data = taken.buffers()
    starts = np.frombuffer(offsets, np.int64, len(taken) + 1, 8 * taken.offset) if len(taken) else np.zeros(1, np.int64)
    lengths = pc.list_value_length(ids).to_pylist()
    ends = starts[np.cumsum([0, *(n or 0 for n in lengths)])].tolist()
    view = memoryview(data or b"")
    return [None if n is None else view[a:b] for n, a, b in zip(lengths, ends, ends[1:])]


def decode(encoded: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the bytes of their ids (null for null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(vocabulary)
        for batch in _few_ids(batches, ids):
            decoded = [None if row is None else bytes(row) for row in _decoded(batch.column(ids), tokens)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{name}` {kind}" for name, kind in encoded.dtypes) + ", decoded binary"
    return encoded.mapInArrow(run, schema)


def digests(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``doc_id, ids``: the ids in
    decimal joined by a space, and the bytes they decode to.  Neither leaves the worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(vocabulary)
        for batch in _few_ids(batches, "ids"):
            ids = batch.column("ids")
            written = pc.binary_join(ids.cast(pa.list_(pa.string())), " ")
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pc.list_value_length(ids).cast(pa.int64()),
                _sha256(row.as_buffer() for row in written), _sha256(_decoded(ids, tokens)),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def _sha256(rows) -> pa.Array:
    return pa.array([None if row is None else hashlib.sha256(row).hexdigest() for row in rows], pa.string())
