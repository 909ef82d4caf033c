"""Column functions over page HTML that need no document tree."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from grantlake.functions.text import non_empty, strip

# A tag name-less marker: splits text like the removed markup did, and is ignored otherwise.
GAP = "<!>"
# Comments, and elements whose text never counts as page text.
HIDDEN_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|rt|rp)\b[^>]*>.*?(?:</\1\s*>|\z)"
# A quote opens a value only after an equals sign; any other is an ordinary character of the tag.
TAG_BODY = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TOKEN = rf"<[a-zA-Z/!?]{TAG_BODY}>|[^<]++|<"
FIRST_H1 = r"(?is)<h1\b[^>]*>(.*?)(?:</h1\s*>|\z)"
# Attributes are passed over possessively, so that a tag of any length is read in one go without recursion.
ONE_ATTRIBUTE = r"""(?!href\s*+=)[^\s>][^\s=>]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
ANCHOR_HREF = rf"""(?is)<a(?=\s)(?:[\s/]*+{ONE_ATTRIBUTE})*+[\s/]*+href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)"""
ATTRIBUTE = r"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""

# The standard's named references, most used first, because a map is searched in order.
FREQUENT = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;", "mdash;", "ndash;", "rsquo;", "lsquo;")
NAMED = {name: html5[name] for name in sorted(html5, key=lambda n: (FREQUENT.index(n) if n in FREQUENT else 99, n))}
# Names that also count without a semicolon, longest first.
BARE = sorted((name for name in NAMED if not name.endswith(";")), key=len, reverse=True)
BARE_NAME = f"^&({'|'.join(BARE)})"
REFERENCE = rf"&(?:#[0-9]++;?|#[xX][0-9a-fA-F]++;?|[a-zA-Z][a-zA-Z0-9]*+;|(?:{'|'.join(BARE)}))"
REPLACEMENT = "\ufffd"


def _windows_1252(code: int) -> str:
    return bytes([code]).decode("cp1252", "ignore") or chr(code)


# Numbers from 128 to 159 stand for characters of the Windows code page.
WINDOWS = {format(code, "x"): _windows_1252(code) for code in range(128, 160)}


def _constant_map(values: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _referenced(reference: Column) -> Column:
    """The character of one reference such as ``&amp;``, ``&#39;`` or ``&#x2019;``; an unknown name stays as it is.

    Numbers that are no character give the replacement character.
    """
    digits = F.regexp_extract(reference, r"#[xX]?0*+([0-9a-fA-F]*)", 1)
    is_hex = reference.rlike("^&#[xX]")
    number = F.when(F.length(digits) > 7, "7fffffff").when(is_hex, F.lower(digits)).otherwise(F.lower(F.conv(digits, 10, 16)))
    wide = F.lpad(number, 8, "0")
    valid = (wide > "00000000") & (wide <= "0010ffff") & ~wide.between("0000d800", "0000dfff")
    character = F.decode(F.unhex(F.when(valid, wide).otherwise("0000fffd")), "UTF-32")
    numeric = F.coalesce(F.try_element_at(_constant_map(WINDOWS), number), character)
    named = _constant_map(NAMED)
    bare = F.regexp_extract(reference, BARE_NAME, 1)
    prefix = F.concat(F.try_element_at(named, bare), F.substring(reference, F.length(bare) + 2, F.length(reference)))
    whole = F.try_element_at(named, F.substring(reference, F.lit(2), F.length(reference)))
    return F.when(reference.startswith("&#"), numeric).otherwise(F.coalesce(whole, F.when(bare != "", prefix), reference))


def decode_entities(text: Column) -> Column:
    """Decode character references once; text without an ampersand is passed on as it is."""
    plain = F.split(text, REFERENCE, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _referenced)
    parts = F.zip_with(plain, F.concat(found, F.array(F.lit(""))), lambda before, char: F.concat(before, char))
    return F.when(F.contains(text, F.lit("&")), F.array_join(parts, "")).otherwise(text)


def visible(html: Column) -> Column:
    """The markup without comments, scripts, styles and other hidden text."""
    return F.regexp_replace(html, HIDDEN_MARKUP, GAP)


def markup_tokens(html: Column) -> Column:
    """Tags and text runs in order."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def fragments(html: Column) -> Column:
    """The stripped, decoded, non-empty text runs of visible markup."""
    runs = F.filter(markup_tokens(html), lambda token: ~token.rlike("^<[a-zA-Z/!?]"))
    texts = F.transform(runs, lambda run: strip(decode_entities(run)))
    return F.filter(texts, lambda text: text != "")


def title(html: Column) -> Column:
    """Text of the first ``h1``: fragments joined by nothing; null if there is none or it is empty."""
    inner = F.regexp_extract(visible(html), FIRST_H1, 1)
    return non_empty(F.array_join(fragments(inner), ""))


def page_text(html: Column) -> Column:
    """All text fragments of a page, one per line."""
    return F.array_join(fragments(visible(html)), "\n")


def unquote(value: Column) -> Column:
    return decode_entities(F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2"))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag token, empty if absent."""
    return unquote(F.regexp_extract(tag, ATTRIBUTE.format(name=name), 1))
