import math
import re
from hashlib import sha256

import xxhash
from pyspark.sql import functions as F

from feedback_signals.llm import catalog, multiset_hash as m

from . import fixtures


def _lanes(text):
    """Sum of the paragraphs' vectors, lane by lane."""
    lanes = [0] * (m.EXACT + m.LIKE)
    for paragraph in (text or "").split("\n"):
        digest = sha256(paragraph.encode()).digest()
        for i in range(m.EXACT):
            lanes[i] += int.from_bytes(digest[4 * i : 4 * i + 4], "big")
        words = [w for w in re.split(r"[\x09-\x0D ]+", paragraph) if w]
        seeded = lambda word, seed: xxhash.xxh64_intdigest(word.encode(), seed=seed)
        hashes = [seeded(b, seeded(a, 42)) for a, b in zip(words, words[1:])] or [seeded(" ".join(words), 42)]
        for h in hashes:
            for j in range(m.LIKE):
                lanes[m.EXACT + j] += 1 if h >> j & 1 else -1
    return [(x + (1 << 31)) % (1 << 32) - (1 << 31) for x in lanes]


def _likeness(a, b):
    if a == b:
        return 1.0
    x, y = a[m.EXACT :], b[m.EXACT :]
    norms = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
    return min(max(sum(v * w for v, w in zip(x, y)) / norms if norms else 0.0, 0.0), 1 - 2.0 ** -20)


def _hex(lanes):
    return "".join(f"{x % (1 << 32):08x}" for x in lanes)


def _wanted(rows):
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0, sha256(
        f"{'-' if r[0] is None else r[0]}:{r[1]}".encode()).digest()))
    after = {r: order[(i + 1) % len(order)][1] for i, r in enumerate(order)}
    out = []
    for i, text in ((r[0], r[1] or "") for r in rows):
        following = after[i, text]
        quota = len(text) // 4
        edited = text[: len(text) - quota] + following[:quota]
        own, changed = _lanes(text), _lanes(edited)
        out.append((
            i, len(text), sha256(edited.encode()).hexdigest(), _hex(own), _hex(changed),
            round(_likeness(own, changed), 9), round(_likeness(own, _lanes(following)), 9),
        ))
    return sorted(out, key=str)


def _found(docs):
    f = m.compare_with_edit(docs)
    own = F.col("lanes")
    return sorted((tuple(r) for r in f.select(
        "doc_id", "n_chars", "edited_sha256", m.as_hex(own), m.as_hex(F.col("edited_lanes")),
        F.round(m.likeness(own, F.col("edited_lanes")), 9), F.round(m.likeness(own, F.col("next_lanes")), 9),
    ).collect()), key=str)


def test_fingerprints_equal_brute_force_on_odd_rows(spark):
    paragraphs = ["first line\nsecond line here\n\nlast", "first line\nsecond line here\n\nlast\n", "\n\n", "äöü 🍐\nß a b c"]
    rows = fixtures.rows([*fixtures.texts(), *paragraphs])
    rows += [(None, "no id\nat all", *rows[0][2:]), (5, "another text under a used id", *rows[0][2:])]
    assert _found(spark.createDataFrame(rows, fixtures.CLASHES)) == _wanted(rows)
    assert m.compare_with_edit(fixtures.empty(spark)).count() == 0
    sole = [(7, "one two three four\nfive six", *rows[0][2:])]
    assert _found(spark.createDataFrame(sole, fixtures.CLASHES)) == _wanted(sole)


def test_query_equals_brute_force_on_whole_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = catalog.QUERIES["op11_multiset_hash"](spark, sf_dir)
    assert dict(found.dtypes) == {
        "doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string",
        "edited_fingerprint": "string", "near_edited": "double", "near_next": "double",
    }
    rounded = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found.collect()]
    assert sorted(rounded, key=str) == _wanted([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_paragraphs_are_inserted_and_deleted_in_any_order(spark):
    texts = ["a b c\nd e\na b c", "d e\na b c\na b c", "a b c\nd e", "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lanes = {r["doc_id"]: r["lanes"] for r in m.fingerprints(docs).collect()}
    assert lanes[0] == lanes[1] != lanes[2]
    row = spark.createDataFrame([(lanes[2], lanes[3], lanes[0])], "a array<int>, b array<int>, c array<int>")
    more, less = row.select(m.insert(F.col("a"), F.col("b")), m.delete(F.col("c"), F.col("b"))).first()
    assert more == lanes[0] and less == lanes[2]


def test_likeness_orders_edits(spark):
    words = fixtures.words(2000, 9, 100_000).split()
    changed = lambda n: " ".join(["other"] * n + words[n:])
    docs = spark.createDataFrame([(n, changed(n)) for n in (0, 200, 1000)] + [(-1, fixtures.words(2000, 10, 100_000))], "doc_id long, text string")
    lanes = {r["doc_id"]: r["lanes"] for r in m.fingerprints(docs).collect()}
    likeness = {i: _likeness(lanes[0], lanes[i]) for i in lanes}
    assert likeness[0] == 1.0 > likeness[200] > likeness[1000] and likeness[200] > likeness[-1] and likeness[-1] < 0.4
