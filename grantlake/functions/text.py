"""Column functions over record text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space in Unicode text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD_PATTERN = "[a-z0-9]+"
SNIPPET_CHARS = 280
EXCERPT_CHARS = 2000


def strip(text: Column) -> Column:
    """Trim all Unicode whitespace (SQL ``trim`` only knows the plain space)."""
    return F.trim(text, F.lit(WHITESPACE))


def non_empty(text: Column) -> Column:
    """Null for an empty string, the text otherwise."""
    return F.nullif(text, F.lit(""))


def tokens(text: Column) -> Column:
    """Lowercased runs of ASCII letters and digits, in order, duplicates kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def record_text(
    title: str | Column = "title",
    description: str | Column = "description",
    eligibility: str | Column = "eligibility",
    category: str | Column = "category",
    state: str | Column = "state_or_territory",
) -> Column:
    """The searchable text of a record: its non-empty fields joined by a space."""
    parts = [F.col(c) if isinstance(c, str) else c for c in (title, description, eligibility, category, state)]
    return F.concat_ws(" ", *[non_empty(part) for part in parts])


def snippet(description: Column) -> Column:
    return non_empty(F.substring(description, 1, SNIPPET_CHARS))


def excerpt(text: Column) -> Column:
    return non_empty(F.substring(text, 1, EXCERPT_CHARS))
