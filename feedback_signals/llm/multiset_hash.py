"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph (what stands between line feeds, empty ones included) hashes to a wide
vector of ``EXACT + LIKE`` lanes; a document's fingerprint is the sum of its
paragraphs' vectors, lane by lane, modulo 2**32.  So it does not depend on the
order of paragraphs, and paragraphs are inserted and deleted by adding and
subtracting their sums (``insert``, ``delete``), without reading the rest.

* The first ``EXACT`` lanes are the eight words of the paragraph's SHA-256: equal
  multisets have equal sums, others differ but for a chance of 2**-256.
* The other ``LIKE`` lanes add, for every pair of consecutive words of the paragraph
  (a shorter one is hashed whole), +1 or -1 by a bit of the pair's XXH64: a random
  projection of the pair counts.  It is linear as well, and the cosine of two such
  projections estimates that of the pair counts (``likeness``), with a standard
  error of at most 1/8.

``compare_with_edit`` cuts a document's last quarter and puts the head of the next document
there.  The fingerprint of the edited text is computed incrementally: the paragraphs
from the cut on are deleted and those of the new tail inserted.

Rows: a null text counts as empty, one empty paragraph.  The next document is the
next one by ascending ``doc_id`` (null ids first), then by a digest of the text;
rows that repeat an id with the same text are one document there, and each of them
is returned with its result.  A sole document is its own next.  An empty table gives
an empty result; further columns are ignored, whatever their names.  A very long
text is one row; only the digests and lanes of its paragraphs are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import Stages
from .ordering import positions

EXACT = 8
LIKE = 64
_MASK = (1 << 32) - 1
#: Two lanes of 32 bits are added up in one long: bit j of a hash, and bit 32 + j.
_TWO_LANES = 1 | 1 << 32
_SPACE = r"[\x09-\x0D ]+"


def _pairs(words: Column) -> Column:
    """Hash of every two consecutive words; the whole sequence if there are fewer."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, n - 1), F.slice(words, 2, n - 1), lambda a, b: F.xxhash64(a, b))
    return F.when(n < 2, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(pairs)


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def sums(groups: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``keys, lanes``: the sum of the vectors of each group's paragraphs, as
    ``array<int>`` of 32-bit lanes; ``column`` holds an array of paragraphs.

    Paragraphs become rows, then pairs; sums are combined before anything is
    shuffled.  A group without a paragraph has no row."""
    # outer generators: an inner one would have its whole input computed twice, by a filter on its size
    single = groups.select(*keys, F.explode_outer(column).alias("_paragraph")).filter(F.col("_paragraph").isNotNull())
    hashed = single.select(
        *keys, F.sha2("_paragraph", 256).alias("_digest"),
        F.filter(F.split("_paragraph", _SPACE), lambda w: w != "").alias("_words"),
    ).select(
        *keys, _pairs(F.col("_words")).alias("_pairs"),
        F.array(*[F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(EXACT)]).alias("_exact"),
    )
    vectors = hashed.select(*keys, "_exact", F.posexplode_outer("_pairs").alias("_at", "_hash"))
    once = F.col("_at") == 0  # a paragraph's digest counts once
    added = vectors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.when(once, F.col("_exact")[i]).otherwise(F.lit(0))).alias(f"_e{i}") for i in range(EXACT)],
        *[F.sum(F.shiftrightunsigned("_hash", j).bitwiseAND(F.lit(_TWO_LANES))).alias(f"_l{j}") for j in range(LIKE // 2)],
    )
    ones = [F.col(f"_l{j}").bitwiseAND(F.lit(_MASK)) for j in range(LIKE // 2)]
    ones += [F.shiftrightunsigned(f"_l{j}", 32) for j in range(LIKE // 2)]
    lanes = [F.col(f"_e{i}") for i in range(EXACT)] + [one * 2 - F.col("_n") for one in ones]
    return added.select(*keys, F.transform(F.array(*lanes), _modulo).alias("lanes"))


def _modulo(lane: Column) -> Column:
    """The lane modulo 2**32, as a signed int."""
    return (F.pmod(lane + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def insert(lanes: Column, more: Column) -> Column:
    """Fingerprint after inserting the paragraphs that ``more`` sums up."""
    return F.zip_with(lanes, more, lambda a, b: _modulo(a.cast("long") + b))


def delete(lanes: Column, gone: Column) -> Column:
    """Fingerprint after deleting the paragraphs that ``gone`` sums up."""
    return F.zip_with(lanes, gone, lambda a, b: _modulo(a.cast("long") - b))


def as_hex(lanes: Column) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(_MASK))), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: cosine of the projections, none below 0.  It is 1 for equal
    fingerprints and for no others."""
    def projection(lanes):
        return F.transform(F.slice(lanes, EXACT + 1, LIKE), lambda x: x.cast("double"))

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)

    x, y = projection(a), projection(b)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    cosine = F.when(norms > 0, dot(x, y) / norms).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1 - 2.0 ** -20)))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, lanes`` of every row."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), paragraphs(F.col(text)).alias("paragraphs")
    )
    return sums(rows, ["row", "doc_id"], "paragraphs").select("doc_id", "lanes")


def _order(stages: Stages, texts: DataFrame) -> DataFrame:
    """``key, doc_id, n_chars`` of every document, the key of the document before it,
    and the number of its characters that go there: the narrow table that tells texts
    where to go."""
    alike = texts.groupBy("key", "doc_id").agg(F.first(F.char_length("text")).alias("n_chars"))
    placed = positions(stages, alike, [], ["doc_id", "key"], "place")
    total = placed.count()
    before = placed.select(
        F.pmod(F.col("place") + 1, F.lit(max(total, 1))).alias("place"), F.col("key").alias("previous"),
        F.floor(F.col("n_chars") / 4).cast("int").alias("wanted"),
    )
    return stages.write(placed.join(before, "place").drop("place"))


def compare_with_edit(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, lanes, edited_lanes, next_lanes`` of every
    row: the edited text's digest, the fingerprints of both texts, and that of the
    next document."""
    stages = Stages(docs.sparkSession)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "key", F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text")), 256))
    )
    order = _order(stages, texts)
    # One shuffle of the texts, read twice: as themselves, and as the heads that go to
    # the document before.  Rows that are the same document are numbered.
    numbered = texts.select("key", "text").repartition("key").withColumn(
        "copy", F.row_number().over(Window.partitionBy("key").orderBy("key"))
    )
    heads = numbered.filter("copy = 1").join(order.select("key", "previous", "wanted"), "key").select(
        F.col("previous").alias("key"), F.expr("left(text, wanted)").alias("head")
    )
    met = numbered.join(order.drop("wanted"), "key").join(heads, "key")
    cut = met.withColumn("kept", F.expr("left(text, n_chars - n_chars div 4)")).withColumn(
        "same", F.size(F.split("kept", "\n", -1)) - 1  # paragraphs that end before the cut
    ).withColumn("edited", F.concat("kept", "head"))
    pieces = cut.select(
        "key", "copy", "doc_id", "previous", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "same",
        paragraphs(F.col("text")).alias("old"), paragraphs(F.col("edited")).alias("new"),
    ).withColumn("piece", F.explode_outer(F.array(
        F.struct(F.lit("same").alias("name"), F.slice("old", 1, F.col("same")).alias("paragraphs")),
        F.struct(F.lit("gone").alias("name"), F.expr("slice(old, same + 1, size(old))").alias("paragraphs")),
        F.struct(F.lit("more").alias("name"), F.expr("slice(new, same + 1, size(new))").alias("paragraphs")),
    )))
    row = ["key", "copy", "doc_id", "previous", "n_chars", "edited_sha256"]
    added = sums(pieces.select(*row, "piece.name", "piece.paragraphs"), [*row, "name"], "paragraphs")
    none = F.array_repeat(F.lit(0), EXACT + LIKE)
    by_piece = added.groupBy(*row).agg(*[
        F.coalesce(F.max(F.when(F.col("name") == name, F.col("lanes"))), none).alias(name) for name in ("same", "gone", "more")
    ])
    done = stages.write(by_piece.withColumn("lanes", insert(F.col("same"), F.col("gone"))).select(
        *row, "lanes", insert(delete(F.col("lanes"), F.col("gone")), F.col("more")).alias("edited_lanes"),
    ), keep=True)
    stages.close()
    following = done.filter("copy = 1").select(F.col("previous").alias("key"), F.col("lanes").alias("next_lanes"))
    return done.join(following, "key").select(
        "doc_id", "n_chars", "edited_sha256", "lanes", "edited_lanes", "next_lanes"
    )
