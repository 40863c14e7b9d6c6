"""Column functions over text. All JVM-side (codegen), no Python in the row path."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that define a "word" for embeddings (E3): letter, then 2+ of letter/digit/_/-,
# matched on lower-cased text.
WORD_PATTERN = "[A-Za-z][A-Za-z0-9_-]{2,}"
# Keyword-overlap tokens (R2): whitespace tokens longer than this many characters.
KEYWORD_MIN_EXCLUSIVE_LEN = 2
# Fixed value: white space as Python's ``str.split()`` has it (Java's ``\\s`` is ASCII only).
SPACE_RUN = (r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
             r"\x{202F}\x{205F}\x{3000}]+")
# Before SPACE_RUN: most characters are passed by one range, not by all of the class's.
_NOT_VISIBLE = "(?![!-~])"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def space_tokens(text) -> Column:
    """Split on the single space only; empty tokens kept, newlines stay inside tokens."""
    return F.split(_c(text), " ", -1)


def count_tokens(text) -> Column:
    """C4: number of space-separated tokens (empty string -> 1 token)."""
    return F.size(space_tokens(text)).cast("bigint")


def keyword_set(text) -> Column:
    """R2: distinct lower-cased whitespace tokens longer than 2 characters."""
    toks = F.split(_c(text), _NOT_VISIBLE + SPACE_RUN, -1)
    kept = F.filter(toks, lambda t: F.char_length(t) > KEYWORD_MIN_EXCLUSIVE_LEN)
    return F.array_distinct(F.transform(kept, lambda t: F.lower(t)))


# The one character that lower-cases to two (``GROWN``), so that a lower-cased word can be longer than it was.
GROWS, GROWN = "\u0130", "i\u0307"


def may_meet_shorter(toks: Iterable[str]) -> bool:
    """Whether a token of ``keyword_set`` can also be a lower-cased word of too few characters. If not, the words
    of a lower-cased text, split as by ``str.split()``, meet ``toks`` just as its ``keyword_set`` does."""
    return any(len(t) - t.count(GROWN) <= KEYWORD_MIN_EXCLUSIVE_LEN for t in toks)


def word_tokens(text) -> Column:
    """Every occurrence of WORD_PATTERN in the lower-cased text."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_PATTERN), 0)


def normalize_ws(text) -> Column:
    """Collapse whitespace runs to one space, trim, lower-case."""
    return F.lower(F.trim(F.regexp_replace(_c(text), SPACE_RUN, " ")))


def contains_normalized(haystack, needle) -> Column:
    """Quote-in-chunk check after whitespace/case normalisation (blank quote matches; a
    null text holds nothing)."""
    return F.coalesce(F.contains(normalize_ws(haystack), normalize_ws(needle)), F.lit(False))


def truncate(text, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(_c(text), 1, n)


def chunk_id(doc_id, index) -> Column:
    """``{doc}_chunk_{i:04d}``; zero-padded to at least 4 digits, never truncated."""
    return F.format_string("%s_chunk_%04d", _c(doc_id).cast("string"), _c(index).cast("int"))


def fixed3(x) -> Column:
    """Render a score with three decimals (half-up on the decimal value)."""
    return F.round(_c(x).cast("decimal(20,9)"), 3).cast("decimal(20,3)").cast("string")
