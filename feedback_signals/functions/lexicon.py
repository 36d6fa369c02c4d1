"""Lexicon matching as one array expression over the text."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

Lexicon = Mapping[str, Sequence[str]]
_END = ""


def shortest_phrases(phrases: Sequence[str]) -> list[str]:
    """Drop phrases that contain another one: a substring test on the shorter
    phrase already covers them."""
    distinct = list(dict.fromkeys(phrases))
    return [p for p in distinct if not any(q != p and q in p for q in distinct)]


def _prefix_tree(phrases: Sequence[str]) -> str:
    """A pattern for any of the phrases, the longest that fits.  Common beginnings are
    shared, so a place in the text is read as far as some phrase goes and no further,
    however many phrases there are."""
    root: dict = {}
    for phrase in phrases:
        node = root
        for letter in phrase:
            node = node.setdefault(letter, {})
        node[_END] = {}

    def pattern(node: dict) -> str:
        ways = [re.sub(r"([^\w\s])", r"\\\1", letter) + pattern(below) for letter, below in sorted(node.items()) if letter]
        body = ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""
        return f"(?:{body})?" if body and _END in node else body

    return pattern(root)


def matched_categories(lowered: Column, lexicon: Lexicon) -> Column:
    """``array<string>`` of the categories met in a lower-cased text, in lexicon
    order; none for a null text.  ``lowered`` should be a column, so that lowering
    happens once.  Empty phrases are ignored.

    One search, in the JVM, whatever the number of phrases: the longest phrase at every
    place of the text.  All others at that place are parts of it, so its categories
    are those of all phrases within it.
    """
    words = {c: shortest_phrases([p for p in ps if p]) for c, ps in lexicon.items()}
    names = [c for c, ps in words.items() if ps]
    phrases = sorted({p for ps in words.values() for p in ps})
    if not phrases:
        return F.array().cast("array<string>")
    met = {p: [i for i, c in enumerate(names) if any(q in p for q in words[c])] for p in phrases}
    categories = F.from_json(F.lit(json.dumps(met)), "map<string,array<int>>")
    hits = F.array_distinct(F.regexp_extract_all(lowered, F.lit(f"(?=({_prefix_tree(phrases)}))"), F.lit(1)))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.element_at(categories, h)))))
    named = F.transform(found, lambda i: F.element_at(F.array(*map(F.lit, names)), i + 1))
    return F.coalesce(named, F.array().cast("array<string>"))
