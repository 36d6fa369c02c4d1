import re
from collections import Counter, defaultdict

import duckdb

from feedback_signals.llm import catalog, divergence

from . import fixtures

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def _brute(rows, min_docs=10):
    counts, docs, kept = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    for lang, terms in docs.items():
        kept[lang] = {t for t, n in terms.items() if n >= min_docs}
    whole = defaultdict(Counter)
    for (lang, _), c in counts.items():
        whole[lang].update(c)

    def weight(count, lang, term):
        total = sum(count[t] for t in kept[lang])
        return 1 + 1_000_000_000 * (count[term] + 2) // (total + 2 * len(kept[lang]))

    out = []
    for (lang, source), own in counts.items():
        p = {t: weight(own, lang, t) for t in kept[lang]}
        pairs, terms = [], []
        for (other_lang, other), theirs in counts.items():
            if other_lang == lang and other != source:
                q = {t: weight(theirs, lang, t) for t in kept[lang]}
                pairs.append((other, sum((p[t] - q[t]) ** 2 // (p[t] + q[t]) for t in p)))
        q = {t: weight(whole[lang], lang, t) for t in kept[lang]}
        terms = [(t, (p[t] - q[t]) ** 2 // (p[t] + q[t])) for t in p if own[t] and p[t] > q[t]]
        order = lambda x: (-x[1], x[0].encode())
        out += [(lang, source, "pair", i, v, k) for k, (i, v) in enumerate(sorted(pairs, key=order), 1)]
        out += [(lang, source, "term", i, v, k) for k, (i, v) in enumerate(sorted(terms, key=order)[:10], 1)]
    return sorted(out, key=str)


def _corpus():
    rows = [(fixtures.words(60, i, 40).replace("w", "Wort-").translate(str.maketrans("0123456789", "abcdeFGHIé")),
             "en" if i % 3 else "fr", f"s{i % 23}") for i in range(150)]
    rows += [(None, None, None), ("", "en", "s1"), ("...", "de", "lonely"), ("word " * 30, "de", ""), ("a b", None, "x"), ("a b", "", None)]
    return rows + [rows[0], rows[0], rows[4]]


def test_report_equals_brute_force_on_odd_rows_and_small_blocks(spark):
    rows = _corpus()
    docs = spark.createDataFrame([(i, *r, 1, "x", "y", 3) for i, r in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, n_chars long, term string, group string, at long")
    wanted = _brute(rows)
    assert {r[2] for r in wanted} == {"pair", "term"}
    for groups, terms in ((16, 4096), (4, 7), (1, 1000)):
        found = divergence.Audit(docs, groups=groups, terms=terms).report()
        assert fixtures.collected(found, *COLUMNS) == wanted
    few = divergence.Audit(docs, min_docs=10 ** 6).report()  # no kept term at all
    assert {r["value"] for r in few.collect()} == {0} and few.count() == sum(r[2] == "pair" for r in wanted)
    assert divergence.Audit(fixtures.empty(spark)).report().count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    wanted = con.execute(catalog.ORACLES["op13_source_divergence"]).fetchall()
    found = catalog.QUERIES["op13_source_divergence"](spark, sf_dir)
    assert fixtures.collected(found, *COLUMNS) == sorted(wanted, key=str)
