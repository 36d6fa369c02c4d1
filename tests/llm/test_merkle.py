import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from feedback_signals.llm import catalog, merkle
from feedback_signals.session import Stages

from . import fixtures

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified")


def _hash(text):
    return sha256(text.encode()).hexdigest()


def _leaf(row, text):
    fields = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return _hash("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _climb(level):
    """The root over a list of hashes, and for each of them its siblings by level."""
    proofs, under = [[] for _ in level], [[i] for i in range(len(level))]
    while len(level) > 1:
        above, held = [], []
        for start in range(0, len(level), 3):
            run = level[start : start + 3]
            for k in range(len(run)):
                for leaf in under[start + k]:
                    proofs[leaf].append((run[:k], run[k + 1 :]))
            above.append(_hash("".join(run)))
            held.append(sum(under[start : start + 3], []))
        level, under = above, held
    return level[0], proofs


def _brute(rows, tamper):
    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    trees = []
    for source in sorted(by_source, key=lambda s: (s is not None, (s or "").encode())):
        held = sorted(by_source[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, r["text"])))
        trees.append((held, *_climb([_leaf(r, r["text"]) for r in held])))
    root, tops = _climb([subroot for _, subroot, _ in trees])
    out = []
    for (held, subroot, proofs), top in zip(trees, tops):
        for row, proof in zip(held, proofs):
            folded, path = _leaf(row, tamper(row)), proof + top
            for left, right in path:
                folded = _hash("".join(left) + folded + "".join(right))
            out.append((row["doc_id"], _leaf(row, row["text"]), subroot, root,
                        "".join("".join(left + right) for left, right in path), folded, folded == root))
    return sorted(out, key=str)


def _found(docs, received):
    found = merkle.audit(docs, received).withColumn("proof", F.lower(F.hex("proof")))
    return sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=str)


def _cut(row):
    return row["text"] and row["text"].replace("\n", "")


def test_proofs_equal_brute_force_on_odd_rows(spark):
    rows = [(i, t, "en", f"s{i % 5}" if i % 7 else None, len(t or ""), *["x"] * 9) for i, t in enumerate(fixtures.texts())]
    rows += [rows[1], rows[1], (None, "no\nid", None, "ä", None, *["x"] * 9), (3, "other\ntext", "de", "s3", 10, *["x"] * 9)]
    docs = spark.createDataFrame(rows, fixtures.CLASHES)
    assert _found(docs, F.translate("text", "\n", "")) == _brute([r.asDict() for r in docs.collect()], _cut)
    assert _found(docs, F.col("text")) == _brute([r.asDict() for r in docs.collect()], lambda r: r["text"])
    assert all(r[-1] for r in _found(docs, F.col("text")))
    assert merkle.audit(fixtures.empty(spark), F.col("text")).count() == 0
    one = docs.filter("doc_id = 4")
    assert _found(one, F.lit("other"))[0][-1] is False and _found(one, F.col("text"))[0][4] == ""


def test_levels_beyond_one_block_and_many_sources(spark):
    """A source of more leaves than a block holds, with a last block of one node, and
    more sources than a run."""
    size = merkle.ARITY ** merkle.BLOCK
    rows = [(i, f"t{i}\n", "en", "big", i) for i in range(2 * size + 1)]
    rows += [(i, f"u{i}\n", "en", f"s{i % 40:02}", i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    received = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    wanted = _brute([r.asDict() for r in docs.collect()], lambda r: _cut(r) if r["doc_id"] % 3 == 0 else r["text"])
    assert _found(docs, received) == wanted


def test_manifest_links_every_node_to_the_root(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = merkle.leaf([F.col(f) for f in merkle.FIELDS])
    manifest = merkle.build(Stages(spark), docs.select("doc_id", "source", F.unhex(own).alias("leaf")), [])
    rows = manifest.lowest.unionByName(manifest.upper).collect()
    nodes = {r["node"]: r["parent"] for r in rows}
    assert len(nodes) == len(rows) and len({r["node"] for r in rows if r["level"] == 0}) == docs.count()
    roots = {parent for parent in nodes.values() if parent not in nodes}
    assert len(roots) == 1
    assert {r["node"] for r in manifest.leaves.collect()} <= set(nodes)


def test_query_equals_brute_force(spark, sf_dir):
    rows = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    even = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
    wanted = sorted(((*r[:4], _hash(r[4]), *r[5:]) for r in _brute(rows, lambda r: _cut(r) if even(r) else r["text"])), key=str)
    found = catalog.QUERIES["op12_merkle_manifest"](spark, sf_dir)
    assert fixtures.collected(found, "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified") == wanted
    assert 0 < sum(r[-1] for r in wanted) < len(wanted)
