"""Repeated passages of ``WINDOW`` words, by prefix-partitioned suffix trees.

Of a passage that repeats, only suffixes that start near an anchor are put into a
tree: the anchor of a window is its least eight-word prefix by hash (leftmost on
ties), so equal windows have equal anchors, and consecutive windows with one anchor
form a piece.  The anchor's eight words are the prefix that pieces are partitioned
by; prefixes that occur in one text only are leaves and are dropped before any text
is moved.  A task holds whole prefixes, at most ``TREE_WORDS`` words at a time, and
builds the subtree of all their suffixes by doubling: suffixes get the number of
their node at depth 1, 2, 4 ... words, and those that share a node at depth
``WINDOW`` are a repeat.  A prefix with more than ``FULL`` words is lengthened to
the whole window; its suffixes meet in a map-side combined minimum, so it may hold a
third of all documents.

A word is removed if a window that covers it also starts in a document with a
smaller id.  Documents with the same words are one text of the least id; the others
lose all words.  Documents of fewer than ``WINDOW`` words (null, empty) lose none,
nor do rows without an id.  Rows that repeat an id and text get the same verdict.
An empty table gives an empty result; further columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from ..session import Stages

WINDOW = 50
GRAM = 8
#: Words of pieces under one prefix; above, the prefix is lengthened.
FULL = 150_000
TREE_WORDS = 400_000
_CACHE = 100_000
#: Windows whose anchors are sought at once, and rows of a batch handled at once.
_BLOCK = 1 << 13
_ROWS = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordKeys(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        key = self[word] = xxh3_64_intdigest(word)
        return key


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _keys(words: list[bytes], cache: _WordKeys) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _ODD
    return values ^ (values >> np.uint64(29))


def pieces(keys: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, first window and number of windows of each piece of a text."""
    n = len(keys) - window + 1
    gram = min(GRAM, window)
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    rolled = np.zeros(len(keys) - gram + 1, dtype=np.uint64)
    for j in range(gram):
        rolled = rolled * _ODD + keys[j : j + len(rolled)]
    rolled = _mixed(rolled)
    choices = np.lib.stride_tricks.sliding_window_view(rolled, window - gram + 1)
    anchors = np.concatenate([
        rolled[begin + np.arange(len(block)) + block.argmin(axis=1)]
        for begin in range(0, n, _BLOCK) if len(block := choices[begin : begin + _BLOCK])
    ])
    starts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    return anchors[starts].view(np.int64), starts, np.diff(np.r_[starts, n])


def _profile(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordKeys()
        for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            n, sha, prefixes, sizes = [], [], [], []
            for text in batch.column(1):
                words = _words(text.as_py())
                n.append(len(words))
                sha.append(sha256(b" ".join(words)).hexdigest())
                prefix, _, count = pieces(_keys(words, cache), window)
                prefix, at = np.unique(prefix, return_inverse=True)
                prefixes.append(prefix)
                sizes.append(np.bincount(at, weights=count + window - 1, minlength=len(prefix)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(prefixes, pa.list_(pa.int64())),
                 pa.array(sizes, pa.list_(pa.int32()))],
                ["doc_id", "n_words", "sha", "prefixes", "sizes"],
            )
    return run


def _cut(window: int, lengthened: bool):
    """Pieces under the wanted prefixes; if ``lengthened``, each of their windows
    under two hashes of all its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordKeys()
        for batch in batches:
            out: list = [[], [], [], []]
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                keys = _keys(_words(text.as_py()), cache)
                prefix, start, count = pieces(keys, window)
                for k in np.flatnonzero(np.isin(prefix, np.array(wanted.as_py(), dtype=np.int64))):
                    body = keys[start[k] : start[k] + count[k] + window - 1]
                    if lengthened:
                        views = np.lib.stride_tricks.sliding_window_view(body, window)
                        for j in range(0, len(views), 1 << 14):
                            x, y = _sums(views[j : j + (1 << 14)])
                            out[0].extend(x)
                            out[1].extend([doc] * len(x))
                            out[2].extend(range(start[k] + j, start[k] + j + len(x)))
                            out[3].extend(y)
                    else:
                        out[0].append(prefix[k])
                        out[1].append(doc)
                        out[2].append(start[k])
                        out[3].append(body.tobytes())
                if len(out[0]) > 5000:
                    yield _batch(out, lengthened)
                    out = [[], [], [], []]
            if out[0]:
                yield _batch(out, lengthened)
    return run


def _batch(out: list, lengthened: bool) -> pa.RecordBatch:
    last = pa.array(np.array(out[3], dtype=np.int64)) if lengthened else pa.array(out[3], pa.binary())
    return pa.RecordBatch.from_arrays([
        pa.array(np.array(out[0], dtype=np.int64)), pa.array(out[1], pa.int64()),
        pa.array(np.array(out[2], dtype=np.int32)), last,
    ], ["prefix", "doc_id", "start", "body"])


def _sums(views: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros(len(views), dtype=np.uint64)
    y = np.zeros(len(views), dtype=np.uint64)
    for j in range(views.shape[1]):
        x = _mixed(x + views[:, j])
        y = (y ^ views[:, j]) * np.uint64(0xD6E8FEB86659FD93) + (y >> np.uint64(32))
    return x.view(np.int64), y.view(np.int64)


def deep_nodes(words: np.ndarray, depth: int) -> np.ndarray:
    """Number of the tree node at ``depth`` for the suffix at each position: two
    suffixes have one number exactly if their first ``depth`` words agree.
    Positions whose suffix is shorter are left out."""
    _, node = np.unique(words, return_inverse=True)
    reach = 1
    while reach < depth:
        step = min(reach, depth - reach)  # the second half may overlap the first
        pair = node[: len(node) - step].astype(np.int64) * (int(node.max()) + 1) + node[step:]
        _, node = np.unique(pair, return_inverse=True)
        reach += step
    return node


def _subtrees(window: int):
    def solve(rows: list) -> pa.RecordBatch:
        lengths = np.array([len(body) // 8 for _, _, body in rows])
        words = np.frombuffer(b"".join(body for _, _, body in rows), dtype=np.uint64)
        owner = np.repeat(np.arange(len(rows)), lengths)
        node = deep_nodes(words, window)
        inside = owner[: len(node)] == owner[window - 1 :]  # windows that do not run into the next piece
        at, node, owner = np.flatnonzero(inside), node[inside], owner[: len(node)][inside]
        doc = np.array([d for d, _, _ in rows], dtype=np.int64)
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc[owner])
        gone = least[node] < doc[owner]
        begin = np.r_[0, np.cumsum(lengths)[:-1]]
        place = at - begin[owner] + np.array([s for _, s, _ in rows], dtype=np.int64)[owner]
        owner, place = owner[gone], place[gone]
        if not len(owner):
            return _ranges([], [], [])
        new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)])
        last = np.r_[new[1:] - 1, len(place) - 1]
        return _ranges(doc[owner[new]], place[new], place[last] + window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, current = [], 0, None
        for batch in batches:
            for prefix, doc, start, body in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if prefix != current and size >= TREE_WORDS:
                    yield solve(rows)
                    rows, size = [], 0
                current = prefix
                rows.append((doc, start, body))
                size += len(body) // 8
        if rows:
            yield solve(rows)
    return run


def _ranges(doc, begin, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(np.array(doc, dtype=np.int64)), pa.array(np.array(begin, dtype=np.int32)),
        pa.array(np.array(end, dtype=np.int32)),
    ], ["doc_id", "begin", "end"])


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
        sha, removed, kept = [], [], []
        for text, ranges in zip(batch.column(1), batch.column(2)):
            words = _words(text.as_py())
            keep = np.ones(len(words), dtype=bool)
            for r in ranges.as_py():
                keep[r["begin"] : r["end"]] = False
            sha.append(sha256(b" ".join(words)).hexdigest())
            removed.append(int((~keep).sum()))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(keep)]).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sha), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "sha", "n_removed", "kept"],
        )


def repeats(docs: DataFrame, stages: Stages, window: int = WINDOW, full: int = FULL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables ``texts`` (doc_id, n_words, sha, copy: whether a smaller id has the
    same words), ``found`` (doc_id, text of documents that share a prefix) and
    ``ranges`` (doc_id, begin, end: words of windows that start in a smaller id)."""
    profile = stages.write(docs.select("doc_id", "text").mapInArrow(
        _profile(window), "doc_id long, n_words long, sha string, prefixes array<long>, sizes array<int>"
    ))
    least = profile.groupBy("sha").agg(F.min("doc_id").alias("least"))
    texts = stages.write(profile.drop("prefixes", "sizes").join(least, "sha").select(
        "doc_id", "n_words", "sha", F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)).alias("copy")
    ), keep=True)
    originals = texts.filter((F.col("n_words") >= window) & ~F.col("copy")).select("doc_id", "sha")
    at = (
        profile.filter(F.col("n_words") >= window).join(originals, ["doc_id", "sha"], "left_semi")
        .select("doc_id", F.explode(F.arrays_zip(F.col("prefixes").alias("prefix"), F.col("sizes").alias("size"))).alias("p"))
        .select("doc_id", "p.prefix", "p.size")
    )
    shared = at.groupBy("prefix").agg(F.count(F.lit(1)).alias("texts"), F.sum("size").alias("words")).filter("texts > 1")
    wanted = at.join(shared, "prefix").groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("words") <= full, F.col("prefix"))).alias("few"),
        F.collect_set(F.when(F.col("words") > full, F.col("prefix"))).alias("many"),
    )
    found = stages.write(docs.select("doc_id", "text").join(wanted, "doc_id"), keep=True)
    stages.drop(profile)
    cut = found.filter(F.size("few") > 0).select("doc_id", "text", "few").mapInArrow(
        _cut(window, False), "prefix long, doc_id long, start int, body binary"
    )
    trees = cut.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(
        _subtrees(window), "doc_id long, begin int, end int"
    )
    long = stages.write(found.filter(F.size("many") > 0).select("doc_id", "text", "many").mapInArrow(
        _cut(window, True), "prefix long, doc_id long, start int, body long"
    ))
    first = long.groupBy("prefix", "body").agg(F.min("doc_id").alias("least"))
    leaves = long.join(first, ["prefix", "body"]).filter("least < doc_id").select(
        "doc_id", F.col("start").alias("begin"), (F.col("start") + window).alias("end")
    )
    return texts, found.select("doc_id", "text"), stages.write(trees.unionByName(leaves))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, full: int = FULL) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row and, where words
    were removed from an original, the text that is left in ``kept`` (else null)."""
    stages = Stages(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts, found, ranges = repeats(rows, stages, window, full)
    held = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    stripped = stages.write(found.join(held, "doc_id").select("doc_id", "text", "ranges").mapInArrow(
        _strip, "doc_id long, sha string, n_removed long, kept string"
    ).dropDuplicates(["doc_id", "sha"]), keep=True)
    stages.close()
    whole = F.col("copy") & (F.col("n_words") >= window)
    return texts.join(stripped, ["doc_id", "sha"], "left").select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce(F.sha2("kept", 256), F.col("sha"))).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
