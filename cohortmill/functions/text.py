"""Text normalisation as Column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware classes and \b, case-insensitive, "\n" as the only line terminator.
CI = "(?iUd)"
CS = "(?Ud)"
# What \s stands for under (?U): trimmed from the ends without reading all between them by a pattern.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def ci(pattern: str) -> str:
    return CI + pattern


def has(col: Column, pattern: str) -> Column:
    """Case-insensitive "pattern occurs in text"; null text counts as no hit."""
    return F.coalesce(col.rlike(ci(pattern)), F.lit(False))


def grab(col: Column, pattern: str, group: int = 0) -> Column:
    """First case-insensitive match of ``group``, or null when the pattern does not occur."""
    return F.when(has(col, pattern), F.regexp_extract(col, ci(pattern), group))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.when(F.length(c) > 0, c) for c in cols])


def strip_chars(col: Column, chars: str) -> Column:
    return F.btrim(col, F.lit(chars))


def strip_ws(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE))


def squeeze(col: Column) -> Column:
    return strip_ws(F.regexp_replace(col, r"(?U)\s+", " "))


def _alnum_words(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, "[^a-z0-9]+", " "))


def normalize_lookup(col: Column) -> Column:
    """Query-side lookup text: trailing minus means negative, plus means positive."""
    low = F.replace(F.lower(col), F.lit("+"), F.lit(" positive "))
    low = F.regexp_replace(low, r"(?U)(?<=\w)-(?=\s|$)", " negative ")
    return _alnum_words(low)


def normalize_catalogue(col: Column) -> Column:
    """Catalogue-side text: like the query side, but without the minus rule."""
    return _alnum_words(F.replace(F.lower(col), F.lit("+"), F.lit(" positive ")))


def clean_semantic(col: Column) -> Column:
    return F.coalesce(normalize_catalogue(col), F.lit(""))


def normalize_term(col: Column) -> Column:
    return F.coalesce(_alnum_words(F.lower(col)), F.lit(""))


def tokens(col: Column) -> Column:
    """Distinct lower-case alphanumeric tokens; an empty array for null text."""
    return F.coalesce(
        F.array_distinct(F.regexp_extract_all(F.lower(col), F.lit("[a-z0-9]+"), F.lit(0))),
        F.array().cast("array<string>"),
    )


def strip_parenthetical(col: Column) -> Column:
    """Remove short bracketed aliases such as "(NSCLC)"."""
    return squeeze(F.regexp_replace(col, r"(?iU)\s*\((?:[a-z0-9][a-z0-9\-/ ]{0,15})\)\s*", " "))


def overlaps(left: Column, right: Column) -> Column:
    """Token-set rule on two token arrays: subset either way, or two common tokens."""
    common = F.size(F.array_intersect(left, right))
    smaller = F.least(F.size(left), F.size(right))
    return (smaller > 0) & ((common == smaller) | (common >= 2))


def content_hash(col: Column) -> Column:
    """SHA-256 of whitespace-squeezed lower-case text (null hashes as the empty string)."""
    return F.sha2(F.lower(squeeze(F.coalesce(col, F.lit("")))), 256)
