"""Template deduction against brute force on small hosts, and odd tables."""

import random
from collections import Counter, defaultdict

from feedback_signals.llm import template
from feedback_signals.session import Stages

SCHEMA = "page_id long, url string, html string"


def page(i, middle, date=""):
    """No article, no word of clutter: only the template tells the parts apart."""
    return (
        f"<body><div class=top><p>Site slogan</p><span>Pick a town</span></div><div class=core><h1>Head {i}</h1>{middle}</div>"
        f"<div class=end><p>All rights kept</p><p>{date}</p></div></body>"
    )


def own(i, n):
    return "".join(f"<p>Own words {i} {k} " + "that fill the page " * 12 + "</p>" for k in range(n))


def test_the_template_alone_finds_the_main_slot(spark):
    rows = [(i, f"http://h.example/{i}", page(i, own(i, 2 + i % 4) + "<p>The same in every page</p>", f"{i} May")) for i in range(9)]
    rows.append((90, "http://h.example/odd", "<body><p>Site slogan</p><article><p>Other layout</p></article></body>"))
    found = {r.page_id: r for r in template.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(9):
        text = found[i].text.split("\n\n")
        assert found[i].by_template and text[0] == f"Head {i}" and text[-1] == "The same in every page"
        assert len(text) == 2 + 2 + i % 4 and found[i].n_chars == len(found[i].text)
    assert not found[90].by_template and found[90].text == "Other layout"


def test_an_article_in_the_template_is_the_slot(spark):
    html = "<body><div class=a><p>{0} side text that is not clutter by name {0}</p></div><article><p>Short {0}</p><p>Share</p></article></body>"
    rows = [(i, f"http://h.example/{i}", html.format(i)) for i in range(5)]
    found = template.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.text for r in found} == {f"Short {i}\n\nShare" for i in range(5)} and all(r.by_template for r in found)


def brute_force(pages):
    """(template tokens, main slot) of one host, from whole vectors and orders."""
    parsed = [template.parse(html).tokens for html in pages]
    about, vectors = {}, {}
    for token in {t for p in parsed for t in p}:
        held = [p[token] for p in parsed if token in p]
        if len(held) < template.SUPPORT or 2 * len(held) < len(pages):
            continue
        vectors[token] = tuple(p[token][1] if token in p else 0 for p in parsed)
        about[token] = (held[0][0], held[0][2], any(h[3] for h in held), sum(h[5] for h in held),
                        held[0][4] and all(n < 2 for n in vectors[token]))

    def ancestors(token, among):
        token, found = about[token][0], []
        while token in about:
            if token in among:
                found.append(token)
            token = about[token][0]
        return found

    classes = defaultdict(list)
    for token, vector in vectors.items():
        classes[vector].append(token)
    kept = set()
    for vector, members in classes.items():
        orders = Counter(tuple(t for t in p if t in members) for p, n in zip(parsed, vector) if n)
        if 2 * max(orders.values()) > sum(orders.values()):
            kept.update(members)
    while True:
        groups = defaultdict(set)
        for token in kept:
            outer = [a for a in ancestors(token, kept) if vectors[a] != vectors[token]]
            chain = ancestors(token, kept)
            stop = next((a for a in chain if vectors[a] != vectors[token]), 0)
            assert not outer or stop in outer
            groups[vectors[token], stop].add(token)
        alone = {t for g in groups.values() if len(g) == 1 for t in g}
        if not alone:
            break
        kept -= alone
    texts = {t for t in kept if about[t][1]}
    left = {e: about[e][3] - sum(about[t][3] for t in texts if e in ancestors(t, kept)) for e in kept - texts}
    best = lambda some: min(some, key=lambda e: (-left[e], e)) if some else None
    articles = [e for e in left if about[e][2] and left[e] > 0]
    if articles:
        return kept, texts, best(articles)
    slot, amount = None, sum(n for e, n in left.items() if not ancestors(e, kept))
    while amount > 0:
        inner = best([e for e in left if ancestors(e, kept)[:1] == ([slot] if slot else []) and about[e][4]])
        if inner is None or left[inner] < template.SHARE * amount:
            break
        slot, amount = inner, left[inner]
    return kept, texts, slot


def random_host(rng):
    """Pages of random nested parts that some pages leave out, repeat or reorder."""
    def part(depth):
        tag = rng.choice(["div class=a", "div class=b", "section", "p", "article", "li"])
        inner = [part(depth + 1) for _ in range(rng.randint(0, 3))] if depth < 3 else []
        return tag, inner, rng.choice(["", "fixed", "fixed", "own", "own"]), rng.random(), rng.random()

    def show(node, page_rng):
        tag, inner, kind, often, moves = node
        if page_rng.random() < 0.3 * often:
            return ""
        inner = list(inner)
        if moves < 0.2:
            page_rng.shuffle(inner)
        text = {"": "", "fixed": f"text of {tag} {often:.2f}", "own": "own " * page_rng.randint(1, 30) + str(page_rng.random())}[kind]
        body = text + "".join(show(n, page_rng) for n in inner for _ in range(page_rng.choice([1, 1, 1, 2])))
        return f"<{tag}>{body}</{tag.split()[0]}>"

    nodes = [part(0) for _ in range(4)]
    return ["<body>" + "".join(show(n, rng) for n in nodes) + "</body>" for _ in range(rng.randint(3, 12))]


def test_deduction_equals_brute_force(spark):
    rng = random.Random(11)
    hosts = {f"h{k}.example": random_host(rng) for k in range(40)}
    rows = [(i, f"http://{host}/{i}", html) for host, pages in hosts.items() for i, html in enumerate(pages)]
    with Stages(spark) as stages:
        pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
        parsed = template.parse_pages(pages, stages)
        found = {r.host: r for r in template.deduce(parsed, stages)[0].collect()}
        salted = template.class_orders(parsed, template.frequent_tokens(parsed), False)
        plain = template.class_orders(parsed, template.frequent_tokens(parsed), True)
        assert salted.exceptAll(plain).count() == 0 and plain.exceptAll(salted).count() == 0
    slots = 0
    for host, pages in hosts.items():
        kept, texts, slot = brute_force(pages)
        if host not in found:
            assert not kept
            continue
        r = found[host]
        assert set(r.template) == texts and r.elements == len(kept) - len(texts) and r.slot == slot, host
        slots += slot is not None
    assert slots >= 10


def test_odd_tables(spark):
    rows = [(i, f"http://h.example/{i}", page(i, own(i, 3))) for i in range(5)]
    rows += [rows[0], (None, None, None), (7, "no url", ""), (8, "http://h.example/8", "<p>" * 20_000 + "deep")]
    clashing = "page_id long, url string, html string, host string, page string, tokens string, slot string, template string"
    df = spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], clashing)
    found = template.extract(df)
    assert found.columns == ["page_id", "url", "text", "n_chars", "by_template"]
    got = found.collect()
    assert len(got) == 9 and len([r for r in got if r.page_id == 0 and r.text.startswith("Head 0")]) == 2
    assert [r.text for r in got if r.page_id in (None, 7)] == ["", ""] and [r.text for r in got if r.page_id == 8] == ["deep"]
    assert template.extract(df.filter("false")).count() == 0
