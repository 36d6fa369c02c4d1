"""Personal data under disguise, with spans in the source.

Base detection finds e-mail addresses, IPv4 addresses, card numbers (Luhn) and
phone numbers as they stand.  Two transducers then rewrite a text, each keeping
the source span of every character it writes: the first folds homoglyphs, full-width
forms and invisible characters; the second folds spelled digits and the disguises
of ``@`` and ``.``, in addresses and between groups of digits.  Identifiers found in the rewritten text are mapped back, and
those that lie on rewritten characters and overlap no base span of their kind are
added.  All scans take time linear in the text.

Null and empty texts have no spans; rows that repeat are reported as they are; an
empty table gives an empty result; further columns are ignored, whatever their
names.  Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"
#: Spelled digits are folded in runs of at least this many.
SPELLED_RUN = 4

# Letters that look like a letter of ASCII, and digit words.
HOMOGLYPHS = {
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "\u2010": "-", "\u2011": "-", "\u2013": "-", "\ufe6b": "@", "\u2024": ".", "\u3002": ".", "\u00a0": " ", "\u202f": " ",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
DIGIT_WORDS = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
_DIGIT = {word: str(n) for words in DIGIT_WORDS.values() for n, word in enumerate(words.split())} | {"oh": "0"}

_FOLD = {**HOMOGLYPHS, **{chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}}
_ODD = re.compile(f"[{re.escape(''.join(_FOLD) + INVISIBLE)}]")
_WORDS = "|".join(sorted(map(re.escape, _DIGIT), key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ ]{{1,3}})?(?:(?:{_WORDS}|[0-9]{{1,4}})[ ,-]{{1,3}}){{{SPELLED_RUN - 1},}}(?:{_WORDS}|[0-9]{{1,4}})(?!\w)", re.I)
_SPELLED_PART = re.compile(rf"plus[ ]+|{_WORDS}|[ ,-]+", re.I)
_AT = r"(?:[ \t]{0,3}[\[({<][ \t]{0,3}(?:at|@)[ \t]{0,3}[\])}>][ \t]{0,3}|[ \t]{1,3}at[ \t]{1,3}|[ \t]{0,3}@[ \t]{0,3})"
_DOT = r"(?:[ \t]{0,3}[\[({<][ \t]{0,3}(?:dot|\.)[ \t]{0,3}[\])}>][ \t]{0,3}|[ \t]{1,3}dot[ \t]{1,3}|\.)"
#: An address up to its first disguise: the part after a disguised @ must hold a
#: (disguised) dot, else "at" is the word.  Labels are at most 63 characters.
_ADDRESS = re.compile(rf"(?<=[A-Za-z0-9_%+-])(?P<at>{_AT})(?P<domain>[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}})+)", re.I)
_DOTS = re.compile(_DOT, re.I)
#: A (disguised) dot between digits, and four or more dotted groups of digits or of
#: up to four digit words.
_DIGIT_DOT = re.compile(rf"(?<=[0-9]){_DOT}(?=[0-9])", re.I)
_GROUP = rf"(?:[0-9]{{1,4}}|(?:{_WORDS})(?:[ ,-]{{1,3}}(?:{_WORDS})){{0,3}})"
_DOTTED = re.compile(rf"(?<!\w)(?:plus[ ]{{1,3}})?{_GROUP}(?:{_DOT}{_GROUP}){{3,}}(?!\w)", re.I)
_DOTTED_PART = re.compile(rf"plus[ ]+|{_WORDS}|{_DOT}|[ ,-]+", re.I)
_LOCAL_DOT = re.compile(rf"(?:[ \t]{{1,3}}dot[ \t]{{1,3}}|[ \t]{{0,3}}[\[({{][ \t]{{0,3}}dot[ \t]{{0,3}}[\])}}][ \t]{{0,3}})$", re.I)
_LOCAL_WORD = re.compile(r"[A-Za-z0-9_%+-]{1,64}$")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    twice = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans per kind, leftmost and non-overlapping."""
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    end = 0
    for match in _DOMAIN.finditer(text):
        start = match.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < match.start():
            end = match.end()
            found["email"].append((start, end))
    for match in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in match.group().split(".")):
            found["ip"].append(match.span())
    for match in _CARD.finditer(text):
        digits = _NO_DIGITS.sub("", match.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(match.span())
    for match in _PHONE.finditer(text):
        if 9 <= len(_NO_DIGITS.sub("", match.group())) <= 15:
            found["phone"].append(match.span())
    return found


class Rewritten:
    """A text after edits ``(start, end, replacement)``, in order and disjoint."""

    def __init__(self, source: str, edits: list[tuple[int, int, str]]):
        parts, self.edits, at, size = [], [], 0, 0
        for start, end, new in edits:
            parts += [source[at:start], new]
            size += start - at
            self.edits.append((size, size + len(new), start, end))
            size += len(new)
            at = end
        self.text = "".join([*parts, source[at:]])
        self._starts = [e[0] for e in self.edits]

    def _place(self, at: int, upper: bool) -> int:
        k = bisect_right(self._starts, at) - 1
        if k < 0:
            return at
        left, right, start, end = self.edits[k]
        if at < right:
            return end if upper else start
        return end + at - right

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Source span of a span that is not empty."""
        if start >= end:
            raise ValueError("empty span")
        last = self._place(end - 1, True)
        k = bisect_right(self._starts, end - 1) - 1
        inside = k >= 0 and end - 1 < self.edits[k][1]
        return self._place(start, False), last if inside else last + 1


def _fold_glyphs(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), _FOLD.get(m.group(), "")) for m in _ODD.finditer(text)]


def _fold_words(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _SPELLED.finditer(text):
        for part in _SPELLED_PART.finditer(run.group()):
            word = part.group().lower()
            if word.startswith("plus"):
                new = "+"
            else:
                new = _DIGIT.get(word, " " if part.start() else "")
            if new != part.group():
                edits.append((run.start() + part.start(), run.start() + part.end(), new))
    for run in _DOTTED.finditer(text):
        for part in _DOTTED_PART.finditer(run.group()):
            word = part.group().lower()
            if word.startswith("plus"):
                new = "+"
            elif _DOTS.fullmatch(word):
                new = "."
            else:
                new = _DIGIT.get(word, "")
            if new != part.group():
                edits.append((run.start() + part.start(), run.start() + part.end(), new))
    edits += [(m.start(), m.end(), ".") for m in _DIGIT_DOT.finditer(text) if m.group() != "."]
    for match in _ADDRESS.finditer(text):
        if match["at"] != "@":
            left = match.start()  # dots of the local part that are spelled out
            dots = []
            while word := _LOCAL_WORD.search(text, max(0, left - 64), left):
                dot = _LOCAL_DOT.search(text, max(0, word.start() - 16), word.start())
                if not dot:
                    break
                dots.append((dot.start(), dot.end(), "."))
                left = dot.start()
            edits += [*dots, (match.start("at"), match.end("at"), "@")]
        base = match.start("domain")
        edits += [(base + d.start(), base + d.end(), ".") for d in _DOTS.finditer(match["domain"]) if d.group() != "."]
    out = []
    for edit in sorted(edits):
        if not out or edit[0] >= out[-1][1]:
            out.append(edit)
    return out


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """``(kind, start, end, base)`` by kind as listed, then start."""
    base = find(text)
    glyphs = Rewritten(text, _fold_glyphs(text))
    words = Rewritten(glyphs.text, _fold_words(glyphs.text))
    added: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if glyphs.edits or words.edits:
        for kind, found in find(words.text).items():
            starts = [s for s, _ in base[kind]]
            for start, end in found:
                source = glyphs.span(*words.span(start, end))
                k = bisect_right(starts, source[1] - 1) - 1
                if text[source[0] : source[1]] != words.text[start:end] and not (k >= 0 and base[kind][k][1] > source[0]):
                    added[kind].append(source)
    return [
        (kind, s, e, is_base) for kind in KINDS
        for s, e, is_base in sorted([(s, e, True) for s, e in base[kind]] + [(s, e, False) for s, e in added[kind]])
    ]


def find_personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, spans``: an array of kind, start, end and whether base detection has it."""
    kind = dict(docs.dtypes)[doc_id]
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "base"), s)) for s in spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, struct)], ["doc_id", "spans"])

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def digest_columns(found: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, their SHA-256, and all spans as text."""
    def listed(column):
        return F.array_join(F.transform(
            column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
