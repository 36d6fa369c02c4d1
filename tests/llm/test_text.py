import base64
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken

from feedback_signals.llm import byte_bpe, pii, template

from . import fixtures

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bpe_equals_the_library_and_round_trips(spark):
    with open(VOCABULARY, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*fixtures.texts(), "x" * 500, " " * 3000, "<|endoftext|>", "日本語" * 300, "\n\n \t" * 100, "a1b2" * 700]
    rows = fixtures.rows(texts)
    wanted = sorted(((r[0], library.encode_ordinary(r[1] or "")) for r in rows), key=str)
    for chunk, overlap in ((byte_bpe.CHUNK, byte_bpe.OVERLAP), (200, 40)):
        encoded = byte_bpe.encode(fixtures.table(spark, texts), VOCABULARY, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
        decoded = byte_bpe.decode(encoded, VOCABULARY).collect()
        assert sorted(((r["doc_id"], r["ids"]) for r in decoded), key=str) == wanted
        assert sorted((r["doc_id"], bytes(r["decoded"])) for r in decoded) == sorted((r[0], (r[1] or "").encode()) for r in rows)
        digests = byte_bpe.digests(encoded, VOCABULARY).collect()
        sha = lambda data: sha256(data).hexdigest()
        assert sorted(map(tuple, digests), key=str) == sorted((
            (r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r[1] or "").encode()))
            for r in rows for ids in [library.encode_ordinary(r[1] or "")]
        ), key=str)
    empty = byte_bpe.encode(fixtures.empty(spark), VOCABULARY, public_tokenizers.PATTERN)
    assert empty.count() == 0 and byte_bpe.digests(empty, VOCABULARY).count() == 0


def test_bpe_decodes_rows_of_any_ids(spark):
    rows = [(1, [0, 1, 2] * 100_000), (2, None), (3, []), (4, [5]), (4, [5]), (None, [49_999])]
    table = spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1)
    by_rank = {v: k for k, v in byte_bpe.load_ranks(VOCABULARY).items()}
    wanted = [(d, None if ids is None else b"".join(by_rank[i] for i in ids)) for d, ids in rows]
    assert [(r.doc_id, None if r.decoded is None else bytes(r.decoded)) for r in byte_bpe.decode(table, VOCABULARY).collect()] == wanted
    for wrong in ([10**8], [-1], [None]):
        bad = spark.createDataFrame([(1, wrong)], "doc_id long, ids array<int>")
        with pytest.raises(Exception):
            byte_bpe.decode(bad, VOCABULARY).collect()


def test_bpe_stitches_a_very_long_pre_token_in_one_walk():
    chunk, overlap = byte_bpe.CHUNK, byte_bpe.OVERLAP
    for text in ("x" * 1_000_000, "ab " * 20_000 + "y" * 200_000 + " cd" * 40_000, " " * 300_000):
        chunks = [text[b : b + chunk + overlap] for b in range(0, len(text), chunk)]
        split = byte_bpe.regex.compile(public_tokenizers.PATTERN)
        heads = [byte_bpe._boundaries(split, c, 0, 0, overlap) for c in chunks]
        tails = [byte_bpe._boundaries(split, c, 0, chunk, len(c) - byte_bpe.AHEAD) for c in chunks]
        pieces = byte_bpe.stitch(chunks, heads, tails, public_tokenizers.PATTERN, chunk)
        assert "".join(pieces) == text
        assert [m for p in pieces for m in split.findall(p)] == split.findall(text)


def _base(text):
    """The rules as they are written, by plain search."""
    import re

    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return {kind: [m.span() for m in re.finditer(p, text) if ok(m.group())] for kind, (p, ok) in rules.items()}


def test_base_spans_equal_the_written_rules():
    import random

    draw = random.Random(5)
    for _ in range(4000):
        text = "".join(draw.choice(["a", "b.c", "@", "@x.y", ".", "%", "1", "25", "256", "300.1", "+1", " ", "-", "(", ") ", "4111", "é", "\n"])
                       for _ in range(draw.randrange(40)))
        assert pii.find(text) == _base(text), text
    card = "4111 1111-1111 1111"
    for text in ("", "a" * 50_000, "1" * 50_000, "1." * 20_000, f"x {card} y", "a@b.c%d@e.f", "+1 (017) 555-7713", "1.2.3.4.5.6.7.8"):
        assert pii.find(text) == _base(text) if len(text) < 1000 else isinstance(pii.find(text), dict)


def test_disguises_map_back_to_the_source():
    def added(text):
        return [(k, text[s:e]) for k, s, e, base in pii.spans(text) if not base]

    assert added("mail jane.doe [at] mail [dot] example [dot] com now") == [("email", "jane.doe [at] mail [dot] example [dot] com")]
    assert added("write jane at example dot com today") == [("email", "jane at example dot com")]
    assert added("jane dot doe (at) example.org") == [("email", "jane dot doe (at) example.org")]
    assert added("jаne@exаmple.com") == [("email", "jаne@exаmple.com")]
    assert added("call plus four nine one seven six five five five one two now") == [
        ("phone", "plus four nine one seven six five five five one two")]
    assert added("４１１１ １１１１ １１１１ １１１１") == [("card", "４１１１ １１１１ １１１１ １１１１")]
    assert added("192.168.o​1.5") == []
    assert added("192.168​.1.5") == [("ip", "192.168​.1.5")]
    for clean in ("we met at noon. Dot com was a boom", "one two three four trees", "at home at work", "Naïve café – déjà vu"):
        assert added(clean) == []


def test_pii_query_columns(spark):
    texts = ["a@b.example and 10.0.0.1", None, "", "x" * 30_000]
    found = {r["doc_id"]: r for r in pii.digest_columns(pii.find_personal_data(fixtures.table(spark, texts))).collect()}
    assert found[0]["spans"] == "email:0:11,ip:16:24" and (found[0]["n_email"], found[0]["n_ip"], found[0]["n_card"]) == (1, 1, 0)
    assert found[0]["base_sha256"] == sha256(b"email:0:11,ip:16:24").hexdigest()
    assert found[1]["spans"] == "" and found[1]["base_sha256"] == sha256(b"").hexdigest()
    assert pii.find_personal_data(fixtures.empty(spark)).count() == 0


def test_main_text_of_odd_markup():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a>Menu</a></ul></nav>'
        '<div class="ad">Buy</div><article><header><h1>Head &amp; line</h1></header><p><b>One\n two<br>three<p>A&nbsp;b &lt;c&gt;'
        '<div class="comments"><p>First!</p></div><form><input>Go</form><p>Last</article><footer>&copy; x</footer>'
    )
    assert template.main_text(page) == "Head & line\n\nOne two three\n\nA b <c>\n\nLast"
    assert template.main_text(None) == template.main_text("") == ""
    assert template.main_text("<p>a<p>b") == "a\n\nb"
    assert template.main_text("plain &am") == "plain &am"


def test_template_text_outside_articles_is_deduced(spark):
    html = lambda i: f"<body><div class=x><p>Site slogan</p></div><div class=y><p>Own words {i}</p><p>{'long ' * (3000 if i == 1 else 1)}</p></div>"
    rows = [(i, f"http://h.example/{i}", html(i), "x") for i in range(6)] + [(9, "http://other.example/", html(9), "x"), (10, None, None, "x")]
    rows.append(rows[0])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = {r["page_id"]: r for r in template.extract(pages).collect()}
    assert found[2]["text"] == "Own words 2\n\nlong" and found[2]["n_chars"] == len(found[2]["text"])
    assert found[9]["text"].startswith("Site slogan") and found[10]["text"] == ""
    assert template.extract(pages).count() == 9 and template.extract(pages.limit(0)).count() == 0
