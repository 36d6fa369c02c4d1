import random
from collections import Counter, defaultdict
from hashlib import sha256

import xxhash
from pyspark.sql import functions as F

from feedback_signals.llm import decontaminate, exact_dedup, sharding, simhash, substring_dedup

from . import fixtures


def test_exact_dedup_equals_brute_force_even_when_all_hashes_collide(spark):
    docs, rows = fixtures.table(spark), fixtures.rows()
    groups = defaultdict(list)
    for row in rows:
        groups[row[1] or ""].append(row[0])
    wanted = sorted(
        ((r[0], max(groups[r[1] or ""]), len(groups[r[1] or ""]), r[0] == max(groups[r[1] or ""]),
          sha256((r[1] or "").encode()).hexdigest()) for r in rows), key=str,
    )
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert fixtures.collected(exact_dedup.extendible_dedup(docs, capacity=2000), *columns) == wanted
    collided = exact_dedup.extendible_dedup(docs, capacity=2000, hash_key=lambda c: F.lit(7).cast("long"))
    assert fixtures.collected(collided, *columns) == wanted
    assert collided.agg(F.max("chain")).first()[0] == len(groups)
    assert exact_dedup.extendible_dedup(fixtures.empty(spark)).count() == 0


def test_directory_splits_until_every_bucket_fits():
    directory = exact_dedup.grow_directory({0: 10, 1: 10, 4: 10, 7: 10}, 15, 3)
    load = Counter()
    for slot, bucket in enumerate(directory):
        load[bucket] += {0: 10, 1: 10, 4: 10, 7: 10}.get(slot, 0)
    assert len(directory) == 8 and max(load.values()) <= 15
    assert exact_dedup.grow_directory({}, 15, 3) == [0]


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


def test_simhash_equals_brute_force(spark):
    rows = fixtures.rows()
    prints = [(r[0], _fingerprint(r[1])) for r in rows]
    roots = _components({p for _, p in prints})
    least = {}
    for i, p in prints:
        least[roots[p]] = min(least.get(roots[p], i), i)
    wanted = sorted(((i, f"{p:016x}", least[roots[p]]) for i, p in prints), key=str)
    for bucket in (4096, 2):
        found = simhash.near_duplicates(fixtures.table(spark), bucket=bucket)
        assert fixtures.collected(found, "doc_id", "fingerprint", "component_id") == wanted
    assert simhash.near_duplicates(fixtures.empty(spark)).count() == 0


def test_links_connect_what_all_pairs_connect_in_full_buckets(spark):
    draw = random.Random(3)
    centres = [draw.getrandbits(64) for _ in range(40)]
    prints = set(centres)
    for c in centres:
        for _ in range(12):
            p = c
            for _ in range(draw.randrange(1, 4)):
                p ^= 1 << draw.randrange(64)
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for bucket in (4096, 3):
        found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket).collect()
        pairs = [(a % (1 << 64), b % (1 << 64)) for a, b in found]
        assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
        root = {p: p for p in prints}

        def find(p):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in pairs:
            root[find(a)] = find(b)
        brute = _components(prints)
        same = defaultdict(set)
        for p in prints:
            same[brute[p]].add(find(p))
        assert all(len(s) == 1 for s in same.values()) and len(same) == len({find(p) for p in prints})


def _kept(rows, window):
    starts = {}
    for i, text in rows:
        w = (text or "").split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            starts[key] = min(starts.get(key, i), i)
    out = []
    for i, text in rows:
        w = (text or "").split()
        gone = set()
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in fixtures.rows()]
    found = substring_dedup.remove_repeats(fixtures.table(spark))
    assert fixtures.collected(found, "doc_id", "n_words", "n_removed", "kept_sha256") == _kept(rows, 50)
    assert any(r[2] == 70 for r in _kept(rows, 50))
    for full in (0, 400):  # all prefixes lengthened, and only those of many words
        found = substring_dedup.remove_repeats(fixtures.table(spark), full=full)
        assert fixtures.collected(found, "doc_id", "n_words", "n_removed", "kept_sha256") == _kept(rows, 50)
    assert substring_dedup.remove_repeats(fixtures.empty(spark)).count() == 0


def test_sharding_fills_shards_evenly_and_gaplessly(spark):
    found = sharding.shard_documents(fixtures.table(spark)).collect()
    assert len(found) == len(fixtures.rows())
    counts = Counter(r["shard"] for r in found)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == shard) == list(range(counts[shard]))
    assert {r["law"] for r in found} == {"rows"} and {r["grown_shard"] for r in found} == {None}
    assert sharding.shard_documents(fixtures.empty(spark)).count() == 0


def test_decontamination_finds_substituted_passages_only(spark):
    item = fixtures.words(40, 50).split()
    changed = [*item[:10], "other", *item[11:20], "words", *item[21:]]
    docs = fixtures.table(spark, [
        None, "", fixtures.words(200, 51), f"{fixtures.words(50, 52)} {' '.join(changed)} {fixtures.words(50, 53)}",
        " ".join(item), "short item here", " ".join(item[:5]),
    ])
    benchmark = spark.createDataFrame([(0, " ".join(item)), (1, None), (2, ""), (3, "Short, item HERE")], "item_id long, text string")
    found = {(r[0], r[1]) for r in decontaminate.contaminated(docs, benchmark).select("doc_id", "item_id").collect()}
    assert found == {(3, 0), (4, 0), (5, 3)}
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(fixtures.empty(spark), benchmark).count() == 0
