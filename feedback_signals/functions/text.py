"""Column expressions over free text (all JVM-side)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from .. import config as C

# Word edges are written out: what ``\b`` means depends on the JDK.
def _no_word_before(first: str) -> str:
    return r"(?<![\p{L}\p{N}_]" + first + ")"


_EDGE_AFTER = r"(?![\p{L}\p{N}_])"
# The look-behind stands after the first character: most positions fail on that
# character alone, before anything is looked up.
NAME_PATTERN = r"[A-Z]" + _no_word_before("[A-Z]") + r"[a-z]{2,}\s+[A-Z][a-z]{2,}" + _EDGE_AFTER
LONG_NUMBER_PATTERN = r"\d" + _no_word_before(r"\d") + r"\d{5,}" + _EDGE_AFTER
WHITE_SPACE = " \t\n\r\x0b\x0c"


def total(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only spaces."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def combined_text(columns: Sequence[Column]) -> Column:
    """Null-safe concatenation of several columns into one clean text."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return squeeze(F.concat_ws(" ", *parts))


def longer_than(text: Column, min_chars: int, stripped: bool = False) -> Column:
    return F.coalesce(F.length(strip(text) if stripped else text) > min_chars, F.lit(False))


def masked_names(text: Column, placeholder: str = C.DEFAULTS.placeholder) -> Column:
    """Capitalised first-and-last-name pairs become ``placeholder``."""
    replacement = placeholder.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, NAME_PATTERN, replacement)


def is_meaningful(text: Column) -> Column:
    """At least 20 characters, no long digit run, at least one real word."""
    keep = (
        (F.length(strip(text)) >= 20)
        & ~text.rlike(LONG_NUMBER_PATTERN)
        & text.rlike("[a-zA-Z]{3,}")
    )
    return F.coalesce(keep, F.lit(False))


def token_count(text: Column) -> Column:
    body = strip(text)
    return F.when(F.length(body) == 0, 0).otherwise(F.size(F.split(body, r"\s+")))


def phrases_present(text: Column, phrases: Sequence[str]) -> Column:
    """How many of ``phrases`` occur (as substrings) in the lower-cased text."""
    lowered = F.lower(text)
    return total(lowered.contains(p).cast("int") for p in phrases)


def feedback_subtype(text: Column, phrases: Sequence[str] = C.FIRST_PERSON_PHRASES) -> Column:
    hits = F.coalesce(phrases_present(text, phrases), F.lit(0))
    own_voice = (hits >= 2) | ((hits == 1) & (token_count(text) < 30))
    return F.when(own_voice, C.SELF).otherwise(C.PEER)


def text_hash(text: Column) -> Column:
    """Join key for texts: the full SHA-256."""
    return F.sha2(text, 256)


def text_key(text: Column) -> Column:
    """Short display key: the first 16 hex digits."""
    return F.substring(F.sha2(text, 256), 1, 16)


def hash_order(row_id: Column, seed: int) -> Column:
    """A reproducible random order that does not depend on partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), row_id.cast("string")))
