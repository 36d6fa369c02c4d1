"""Queries of this subpackage, over whole tables, and their SQL where one exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    byte_bpe, decontaminate, divergence, exact_dedup, merkle, multiset_hash, pii, sharding, simhash, substring_dedup, template,
    toxicity, warc,
)

QUERIES = {}
ORACLES = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.extendible_dedup(_table(spark, sf_dir, "documents")).drop("bucket", "chain")


ORACLES["op5_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@_query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


@_query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


@_query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)
    return byte_bpe.digests(encoded, vocabulary)


@_query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages")).drop("path")


ORACLES["op3_warc"] = """
WITH rows AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), marked AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM rows
)
SELECT page_id, url, payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM marked
"""


@_query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumn(
        "n_passages", F.size("passages").cast("long")
    ).drop("passages")


@_query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find_personal_data(_table(spark, sf_dir, "documents")))


@_query
def op8_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(_table(spark, sf_dir, "pages"))


@_query
def op11_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multiset_hash.compare_with_edit(_table(spark, sf_dir, "documents"))
    own, edited, following = F.col("lanes"), F.col("edited_lanes"), F.col("next_lanes")
    return found.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256",
        multiset_hash.as_hex(own).alias("fingerprint"), multiset_hash.as_hex(edited).alias("edited_fingerprint"),
        multiset_hash.likeness(own, edited).alias("near_edited"), multiset_hash.likeness(own, following).alias("near_next"),
    )


@_query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    received = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.audit(_table(spark, sf_dir, "documents"), received).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), "folded_root", "verified"
    )


ORACLES["op12_merkle_manifest"] = """
WITH RECURSIVE received AS (
  SELECT *, CASE WHEN list_reduce(
           list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT)),
           lambda crc, byte: list_reduce(range(8)::UBIGINT[], lambda k, i: CASE WHEN k % 2 = 1 THEN xor(k // 2, 3988292384) ELSE k // 2 END, xor(crc, byte)),
           4294967295::UBIGINT) % 2 = 1  -- of the inverted remainder
         THEN replace(text, chr(10), '') ELSE text END AS received
  FROM documents
), fields AS (
  SELECT *, concat(
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head
  FROM received
), leaves AS (
  SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(received) || ':' || received, '-')) AS start,
         dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) AS tree
  FROM fields
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), lower_nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM lower_nodes) WHERE n > 1 GROUP BY tree, level, pos // 3
), subroots AS (
  SELECT tree, arg_max(h, level) AS subroot FROM lower_nodes GROUP BY tree
), upper_nodes AS (
  SELECT 0 AS level, tree - 1 AS pos, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM upper_nodes) WHERE n > 1 GROUP BY level, pos // 3
), lower_runs AS (
  SELECT tree, level, pos // 3 AS run, list(h ORDER BY pos) AS h FROM lower_nodes
  WHERE level < (SELECT max(level) FROM lower_nodes m WHERE m.tree = lower_nodes.tree) GROUP BY ALL
), upper_runs AS (
  SELECT level, pos // 3 AS run, list(h ORDER BY pos) AS h FROM upper_nodes
  WHERE level < (SELECT max(level) FROM upper_nodes) GROUP BY ALL
), climb AS (
  SELECT tree, pos AS leaf_pos, 0 AS level, pos, start AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT c.tree, c.leaf_pos, c.level + 1, c.pos // 3,
         sha256(array_to_string(r.h[:c.pos % 3], '') || c.folded || array_to_string(r.h[c.pos % 3 + 2:], '')),
         c.proof || array_to_string(r.h[:c.pos % 3], '') || array_to_string(r.h[c.pos % 3 + 2:], '')
  FROM climb c JOIN lower_runs r ON r.tree = c.tree AND r.level = c.level AND r.run = c.pos // 3
), climbed AS (
  SELECT tree, leaf_pos, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM climb GROUP BY ALL
), ascent AS (
  SELECT tree, leaf_pos, 0 AS level, tree - 1 AS pos, folded, proof FROM climbed
  UNION ALL
  SELECT c.tree, c.leaf_pos, c.level + 1, c.pos // 3,
         sha256(array_to_string(r.h[:c.pos % 3], '') || c.folded || array_to_string(r.h[c.pos % 3 + 2:], '')),
         c.proof || array_to_string(r.h[:c.pos % 3], '') || array_to_string(r.h[c.pos % 3 + 2:], '')
  FROM ascent c JOIN upper_runs r ON r.level = c.level AND r.run = c.pos // 3
), risen AS (
  SELECT tree, leaf_pos, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM ascent GROUP BY ALL
), top AS (
  SELECT arg_max(h, level) AS root FROM upper_nodes
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM placed JOIN risen ON risen.tree = placed.tree AND risen.leaf_pos = placed.pos
JOIN subroots ON subroots.tree = placed.tree CROSS JOIN top
"""


@_query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.Audit(_table(spark, sf_dir, "documents")).report()


ORACLES["op13_source_divergence"] = r"""
WITH words AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), terms AS (
  SELECT doc, lang, source, unnest(words) AS term FROM words
), kept AS (
  SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM words
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), weights AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000 * (coalesce(c.n, 0)::HUGEINT + 2)) // (g.total + 2 * l.v) AS HUGEINT) AS p,
         CAST(1 + (1000000000 * (k.n::HUGEINT + 2)) // (l.total + 2 * l.v) AS HUGEINT) AS q
  FROM totals g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM weights a JOIN weights b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source
  LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = o.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM weights WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INT) AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
