"""Main text by template deduction from equivalence classes.

Pages of one host come from one template.  A page is a sequence of tokens: its tags,
qualified by the path of tags and classes they stand in, and its blocks of text,
qualified alike.  A token's occurrence vector is how often each page of the host
holds it; it is kept as a count of pages and a sum of hashes, which combine on the
map side, so that a host with any number of pages is never gathered in one task.
Only tokens that at least ``SUPPORT`` pages and half of the host's pages hold are
followed up; a host has at most twice as many of them as an average page has tokens.

Tokens with equal vectors form an equivalence class.  It is valid if it has at least
two tokens, if one order of their first occurrences holds on most of its pages, and
if it nests: the outermost of its tokens stand in one element of another class.  A
class whose outermost tokens stand in several elements is two classes that have their
counts in common, and is divided by these elements.  Valid classes make the template:
its elements are the slots, its blocks of text are template text.

The main slot of a host is deduced from what is left in the slots, the pages' own
text outside known clutter.  Where template elements are articles (or main), the
fullest is the main slot.  Otherwise it is found from the outside in: a slot gives
way to the element inside it that occurs once a page and has at least ``SHARE`` of
its own text.  All of a page's text in the main slot is returned, whatever repeats
over pages; if a page has an article within the slot, the article's.  A page without
its host's main slot, or of a host without template, is read by its own article or,
if it has none, gives its text without template text.

Menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles
and comments are known by tag, role, id or class and left out everywhere.

Null and empty html give an empty text; a null url is a host of its own, as is one
that cannot be parsed.  Rows that repeat a page are extracted alike.  Hosts with few
pages have no template.  Very long pages are read whole; below a depth of 200, tags
count as the element they stand in.  Of slots with as much text the one with the
smaller token wins.  Empty tables give empty results; further columns are ignored,
whatever their names.

Every page is parsed once; its tokens and blocks are stored in the shared folder, and
all later steps read them there.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from ..session import Stages

SUPPORT = 4
SHARE = 0.9
BROADCAST_TOKENS = 200_000
SALTS = 16
#: Pages that are handed to Spark at once.
SLICE = 128

# Names of elements, and words in roles, ids and classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea iframe svg canvas "
    "object dialog menu".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr br".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
    "table ul".split()
)
HOLDERS = frozenset("article body center div html main section table tbody td tr".split())
CONTAINERS = frozenset("article aside body blockquote div footer form header html li main nav section table td th".split())
CLUTTER = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent footer menu "
    "nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor sponsored "
    "subscribe widget disqus replies".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_PARTS = re.compile(r"[A-Za-z]+")
#: White space of HTML text; a no-break space is one too once text is shown.
_SPACE = re.compile(r"\s+")


_ROOT = 0


def _token(kind: str, path: str, text: str = "") -> int:
    return xxh64_intdigest(f"{kind}{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


class Page(HTMLParser):
    """Tokens and blocks of a page.

    ``tokens`` holds for each, in order of first occurrence, the element it stands in,
    its count, whether it is text, is an article or main, may hold a main text, and
    the characters of text outside clutter that it has inside.  ``blocks`` holds
    (elements from the outside in, token, text, skipped, inside article or main).
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # name, skipped, main
        self.paths: list[str] = [""]
        self.ids: list[int] = [_ROOT]
        self.tokens: dict[int, list] = {}
        self.blocks: list[tuple[tuple[int, ...], int, str, bool, bool]] = []
        self._held: list[str] = []

    def _count(self, token: int, text: bool, main: bool, holds: bool, chars: int = 0) -> None:
        entry = self.tokens.get(token)
        if entry is None:
            self.tokens[token] = [self.ids[-1], 1, text, main, holds, chars]
        else:
            entry[1] += 1
            entry[5] += chars

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self._held)).strip()
        self._held = []
        if text:
            _, skipped, main = self.stack[-1] if self.stack else ("", False, False)
            token, chars = _token("t", self.paths[-1], text), 0 if skipped else len(text)
            around = tuple(dict.fromkeys(self.ids[1:]))
            self._count(token, True, False, False, chars)
            for element in around:
                self.tokens[element][5] += chars
            self.blocks.append((around, token, text, skipped, main))

    def _pop(self, depth: int) -> None:
        del self.stack[depth:]
        del self.paths[depth + 1 :]
        del self.ids[depth + 1 :]

    def _up_to(self, names: frozenset[str] | tuple[str, ...], stop: frozenset[str]) -> int | None:
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] in names:
                return depth
            if self.stack[depth][0] in stop:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self._held.append(" ")
            return
        if tag not in INLINE:
            self._flush()
        if tag in CLOSES_P and (depth := self._up_to(("p",), CONTAINERS)) is not None:
            self._pop(depth)
        if tag == "li" and (depth := self._up_to(("li",), frozenset(("ul", "ol")))) is not None:
            self._pop(depth)
        if tag == "body":  # ends an unclosed head
            self._pop(0)
        values = {name: value or "" for name, value in attrs}
        marks = sorted(set(_PARTS.findall(f"{values.get('class', '')} {values.get('id', '')}".lower())))
        _, skipped, main = self.stack[-1] if self.stack else ("", False, False)
        hidden = "hidden" in values or values.get("aria-hidden") == "true"
        clutter = tag not in ("body", "html", "article", "main") and not CLUTTER.isdisjoint(marks)
        remark = tag == "article" and not {"comment", "comments", "ad", "advert"}.isdisjoint(marks)
        skipped = (
            skipped or tag in SKIP or hidden or clutter or remark or values.get("role", "").lower() in ROLES
            or (tag == "header" and not main)
        )
        article = tag in ("article", "main") or values.get("role", "").lower() == "main"
        main = main or article
        deep = len(self.paths) >= 200
        if skipped and tag in INLINE:
            self._flush()
        path = self.paths[-1] if deep else f"{self.paths[-1]}/{tag}{'.'.join(['', *marks])}"
        element = self.ids[-1] if deep else _token("<", path)
        if not deep:
            self._count(element, False, article and not skipped, tag in HOLDERS)
        if tag not in VOID:
            self.stack.append((tag, skipped, main))
            self.paths.append(path)
            self.ids.append(element)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing but void elements

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        stop = CONTAINERS - {tag} if tag in INLINE or tag == "p" else frozenset()
        depth = self._up_to((tag,), stop)
        if depth is not None:
            if self.stack[depth][1]:
                self._flush()
            self._pop(depth)

    def handle_data(self, data: str) -> None:
        if not (self.stack and self.stack[-1][0] in ("script", "style")):
            self._held.append(data)

    def close(self) -> None:
        super().close()
        self._flush()


def parse(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    page.close()
    return page


def main_text(html: str | None, template: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of a page read by itself, given the template text tokens of its host."""
    blocks = [b for b in parse(html).blocks if not b[3]]
    inside = [text for _, _, text, _, main in blocks if main]
    return "\n\n".join(inside or [text for _, token, text, _, _ in blocks if token not in template])


_TOKENS = "token: long, around: long, n: int, text: boolean, main: boolean, holds: boolean, chars: long, first: int"
_BLOCKS = "around: array<long>, token: long, text: string, skipped: boolean, main: boolean"
_TOKEN_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32()]
_TOKEN_NAMES = ["token", "around", "n", "text", "main", "holds", "chars", "first"]


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    offsets = [0]
    for size in sizes:
        offsets.append(offsets[-1] + size)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``tokens`` and ``blocks`` in place of the last column, the html."""
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE):
            cut = batch.slice(begin, SLICE)
            pages = [parse(html) for html in cut.column(cut.num_columns - 1).to_pylist()]
            tokens = [(t, *e, i) for p in pages for i, (t, e) in enumerate(p.tokens.items())]
            columns = list(zip(*tokens)) or [()] * len(_TOKEN_NAMES)
            blocks = [b for p in pages for b in p.blocks]
            around = _lists([len(b[0]) for b in blocks], pa.array([e for b in blocks for e in b[0]], pa.int64()))
            of_blocks = [around, *(
                pa.array([b[i] for b in blocks], kind)
                for i, kind in enumerate([pa.int64(), pa.string(), pa.bool_(), pa.bool_()], 1)
            )]
            yield pa.RecordBatch.from_arrays([
                *cut.columns[:-1],
                _lists([len(p.tokens) for p in pages], pa.StructArray.from_arrays(
                    [pa.array(c, kind) for c, kind in zip(columns, _TOKEN_TYPES)], _TOKEN_NAMES)),
                _lists([len(p.blocks) for p in pages], pa.StructArray.from_arrays(
                    of_blocks, ["around", "token", "text", "skipped", "main"])),
            ], [*cut.schema.names[:-1], "tokens", "blocks"])


def frequent_tokens(parsed: DataFrame) -> DataFrame:
    """Tokens that many of a host's pages hold, with their class by equal vectors."""
    counts = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    vectors = parsed.select("host", "page", F.explode("tokens").alias("t")).groupBy("host", "t.token").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("t.n").alias("occurrences"),
        F.sum(F.xxhash64("page", "t.n").cast("decimal(20,0)")).alias("vector"),
        F.min("t.around").alias("around"), F.max("t.text").alias("text"), F.max("t.main").alias("main"),
        F.max("t.holds").alias("holds"), F.sum("t.chars").alias("chars"),
    ).filter(F.col("pages") >= SUPPORT)
    return vectors.join(counts, "host").filter(F.col("pages") * 2 >= F.col("host_pages")).select(
        "host", "token", F.xxhash64("pages", "vector").alias("class"), "around", "text", "main", "chars",
        (F.col("holds") & (F.col("occurrences") == F.col("pages"))).alias("holds"),
    )


def _join(rows: DataFrame, table: DataFrame, keys: list[str], small: bool, how: str = "inner") -> DataFrame:
    """Join with a table of the hosts; one of unknown size is repeated per salt, as a
    host may hold any share of the rows."""
    if small:
        return rows.join(F.broadcast(table), keys, how)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("page", F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], how).drop("salt")


def class_orders(parsed: DataFrame, frequent: DataFrame, small: bool) -> DataFrame:
    """``host, class, ordered``: whether one order of a class's tokens holds on more than
    half of its pages.  What is gathered are tokens of one page."""
    tokens = parsed.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.token", "t.first")
    placed = _join(tokens, frequent.select("host", "token", "class"), ["host", "token"], small)
    order = F.transform(F.array_sort(F.collect_list(F.struct("first", "token"))), lambda e: e["token"])
    per_page = placed.groupBy("host", "class", "page").agg(F.xxhash64(order).alias("order"))
    per_order = per_page.groupBy("host", "class", "order").agg(F.count(F.lit(1)).alias("n"))
    return per_order.groupBy("host", "class").agg((F.max("n") * 2 > F.sum("n")).alias("ordered"))


def nest(tokens: dict[int, dict]) -> dict[int, int]:
    """The template: each token of a valid class with the template element it stands in
    (``_ROOT`` for none).  ``tokens`` gives ``class``, ``around`` and ``ordered`` of each."""
    valid = {t for t, v in tokens.items() if v["ordered"]}
    while True:
        inside: dict[int, int] = {}
        for token in valid:
            element = tokens[token]["around"]
            while element not in valid and element in tokens:
                element = tokens[element]["around"]
            inside[token] = element if element in valid else _ROOT
        groups = defaultdict(set)
        for token in valid:
            kind, element = tokens[token]["class"], inside[token]
            while element != _ROOT and tokens[element]["class"] == kind:
                element = inside[element]  # up to what the outermost of the class stands in
            groups[kind, element].add(token)
        alone = {t for group in groups.values() if len(group) < 2 for t in group}
        if not alone:
            return inside
        valid -= alone


def main_slot(tokens: dict[int, dict], inside: dict[int, int]) -> int | None:
    """The element of the template whose text is the pages' main text."""
    own = {t: tokens[t]["chars"] for t in inside if not tokens[t]["text"]}
    for token in inside:
        element = inside[token] if tokens[token]["text"] else _ROOT
        while element != _ROOT:
            own[element] -= tokens[token]["chars"]
            element = inside[element]
    fullest = lambda elements: min(elements, key=lambda t: (-own[t], t), default=None)
    articles = [t for t in own if tokens[t]["main"] and own[t] > 0]
    if articles:
        return fullest(articles)
    slot, text = None, sum(own[t] for t in own if inside[t] == _ROOT)
    while text > 0:
        here = slot or _ROOT
        inner = fullest([t for t in own if inside[t] == here and tokens[t]["holds"]])
        if inner is None or own[inner] < SHARE * text:
            break
        slot, text = inner, own[inner]
    return slot


def _templates(frame: pd.DataFrame) -> pd.DataFrame:
    tokens = {row.pop("token"): row for row in frame.drop(columns="host").to_dict("records")}
    inside = nest(tokens)
    texts = sorted(t for t in inside if tokens[t]["text"])
    return pd.DataFrame({
        "host": [frame["host"].iat[0]], "slot": pd.array([main_slot(tokens, inside)], "Int64"),
        "elements": [len(inside) - len(texts)], "template": [texts],
    })


def deduce(parsed: DataFrame, stages: Stages) -> tuple[DataFrame, bool]:
    """``host, slot, elements, template`` (the text tokens) of every host with frequent
    tokens, and whether that table may be broadcast.  The frequent tokens of a host
    are one group: they are fewer than twice the tokens of its average page."""
    frequent = stages.write(frequent_tokens(parsed))
    small = frequent.count() <= BROADCAST_TOKENS
    orders = class_orders(parsed, frequent, small)
    marked = frequent.join(orders, ["host", "class"], "left").withColumn("ordered", F.coalesce("ordered", F.lit(False)))
    found = marked.groupBy("host").applyInPandas(
        _templates, "host string, slot long, elements long, template array<long>"
    )
    template = stages.write(found, keep=True)
    stages.drop(frequent)
    return template, small


def parse_pages(
    pages: DataFrame, stages: Stages, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """The stored table of pages with their host, tokens and blocks."""
    kind = dict(pages.dtypes)[page_id]
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"),
        F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))).alias("host"),
        F.xxhash64(page_id, url, F.length(html)).alias("page"), F.coalesce(F.col(html), F.lit("")).alias("html"),
    )
    return stages.write(rows.mapInArrow(
        _parsed, f"page_id {kind}, url string, host string, page long, "
        f"tokens array<struct<{_TOKENS}>>, blocks array<struct<{_BLOCKS}>>"
    ), keep=True)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row, and ``by_template``: whether the text
    comes from the main slot of the host's template."""
    stages = Stages(pages.sparkSession)
    parsed = parse_pages(pages, stages, page_id, url, html)
    template, small = deduce(parsed, stages)
    joined = _join(parsed.drop("tokens"), template, ["host"], small, "left")
    shown = F.filter("blocks", lambda b: ~b["skipped"])
    slotted = F.filter("shown", lambda b: F.array_contains(b["around"], F.col("slot")))
    article = lambda blocks: F.filter(blocks, lambda b: b["main"])
    others = F.filter("shown", lambda b: ~F.array_contains(F.coalesce("template", F.array().cast("array<long>")), b["token"]))
    some = lambda blocks: F.size(blocks) > 0
    by_template = F.col("slot").isNotNull() & some("slotted")
    chosen = (
        F.when(by_template & some(article("slotted")), article("slotted")).when(by_template, F.col("slotted"))
        .when(some(article("shown")), article("shown")).otherwise(others)
    )
    return (
        joined.withColumn("shown", shown).withColumn("slotted", F.when(F.col("slot").isNotNull(), slotted))
        .select(
            "page_id", "url", F.array_join(F.transform(chosen, lambda b: b["text"]), "\n\n").alias("text"),
            by_template.alias("by_template"),
        )
        .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_template")
    )

