"""The element tree of whole batches of pages, in the task that scans them.

A page is one row, so nothing about its structure needs a shuffle. Pages of an Arrow batch are taken apart many together: their
tokens are numbered through, nesting levels are running sums over all of them, and what an element holds is a range of the numbers:
from its own to that of the next element on its level, as far as the level is not below it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from grantlake.functions.html import ATTRIBUTE, GAP, HIDDEN_MARKUP, TOKEN
from grantlake.functions.text import WHITESPACE
from grantlake.session import bound_batches, spread

# Fixed values from the HTML standard.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
)
INLINE_TAGS = (
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "button", "cite", "code", "data", "del", "dfn", "em", "font",
    "i", "ins", "kbd", "label", "mark", "nobr", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var",
)
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup",
    "html", "li", "main", "menu", "nav", "ol", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead",
    "tr", "ul",
)
LISTS = ("ul", "ol", "menu")
ROW_GROUPS = ("tbody", "thead", "tfoot")
# Elements whose end tag may be left out: (elements, opening tags that end them, closing tags
# that end them, opening tags that nest inside them).
OPTIONAL_END = (
    (("p",), BLOCK_TAGS, BLOCK_TAGS, ()),
    (("li",), (), LISTS, LISTS),
    (("dt", "dd"), (), ("dl",), ("dl",)),
    (("td", "th"), ("tr", *ROW_GROUPS), ("tr", "table", *ROW_GROUPS), ("table",)),
    (("tr",), ROW_GROUPS, ("table", *ROW_GROUPS), ("table",)),
    (ROW_GROUPS, (), ("table",), ("table",)),
)
# A void or self-closed element is a leaf: it opens nothing, but it is there.
OPEN, CLOSE, TEXT, LEAF = 1, 2, 3, 4
# What a tag means to a group of elements with optional end tags.
NOTHING, BEGIN, END, NEST, OUT = 0, 1, 2, 3, 4

# White space and letters of markup are ASCII.
HIDDEN = re.compile("(?a)" + HIDDEN_MARKUP.replace(r"\z", r"\Z"))
TOKENS = re.compile("(?a)" + TOKEN)
TAG = re.compile(r"(?a)</?([a-zA-Z][^\s/>]*)")
CLASS, HREF = (re.compile("(?a)" + ATTRIBUTE.format(name=name)) for name in ("class", "href"))
# Distinct tags a task remembers the meaning of.
MAX_KNOWN_TAGS = 100_000
# Bytes of markup whose trees a task holds at once; a longer page is taken alone.
PIECE_BYTES = 1024 * 1024
# Codes of a text run and of tags that mean nothing; all others are places in a task's table of tags.
RUN, SKIPPED = 0, -1


def tag_meaning(token: str) -> tuple[int, str, tuple[int, ...]] | None:
    """Kind and name of a tag, and what it means to each group of optional ends; None for declarations and markers."""
    found = TAG.match(token)
    if not found:
        return None
    tag = found[1].lower()
    closes = token.startswith("</")
    if not closes and (tag in VOID_TAGS or token.endswith("/>")):
        return LEAF, tag, (NOTHING,) * len(OPTIONAL_END)
    events = []
    for items, open_ends, close_ends, nested in OPTIONAL_END:
        if tag in items:
            events.append(END if closes else BEGIN)
        elif not closes and tag in nested:
            events.append(NEST)
        else:
            events.append(OUT if tag in (close_ends if closes else open_ends) else NOTHING)
    return (CLOSE if closes else OPEN), tag, tuple(events)


class Tags:
    """The distinct tags a task has met, numbered: kind, name and meaning by code."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.kinds, self.names, self.events = [TEXT], [""], [(NOTHING,) * len(OPTIONAL_END)]

    def add(self, token: str) -> int:
        meaning = tag_meaning(token)
        if meaning is None:
            self.codes[token] = SKIPPED
            return SKIPPED
        for known, value in zip((self.kinds, self.names, self.events), meaning):
            known.append(value)
        self.codes[token] = len(self.kinds) - 1
        return self.codes[token]


class PageTree:
    """Tokens of many pages in order: `page`, `kind`, `tag`, `token`, `text`, and the nesting `level` of each.

    Block structure is counted over a whole page, with left-out end tags filled in. Inline elements are counted from the last
    block tag on, so an unclosed `<b>` cannot shift what follows it.
    """

    def __init__(self, pages: Iterable[str | None], tags: Tags | None = None) -> None:
        tags = Tags() if tags is None else tags
        if len(tags.codes) > MAX_KNOWN_TAGS:
            tags.clear()
        page, codes = [], []
        self.token: list[str] = []
        self.text: list[str] = []
        code_of, keep_token, keep_text, keep_code = tags.codes.get, self.token.append, self.text.append, codes.append
        for number, markup in enumerate(pages):
            for token in TOKENS.findall(HIDDEN.sub(GAP, markup or "")):
                code, text = code_of(token), ""
                if code is None:
                    if token[0] == "<" and len(token) > 1:
                        code = tags.add(token)
                    else:
                        text = token.strip(WHITESPACE)
                        if not text:
                            continue
                        if "&" in text:
                            text = html.unescape(token).strip(WHITESPACE)
                        code = RUN
                if code != SKIPPED:
                    keep_code(code)
                    keep_token(token)
                    keep_text(text)
            page.append(len(codes))
        code = np.array(codes, np.int64)
        self.page = np.repeat(np.arange(len(page)), np.diff([0, *page]))
        self.kind = np.array(tags.kinds)[code]
        self.names, self.name = np.unique(np.array(tags.names), return_inverse=True)
        self.name = self.name[code]
        self.begins = np.searchsorted(self.page, self.page)
        self.level = self._levels(np.array(tags.events, np.int64)[code])

    def tag(self, at: int) -> str:
        return str(self.names[self.name[at]])

    def __len__(self) -> int:
        return len(self.page)

    def _last(self, marked: np.ndarray) -> np.ndarray:
        """The last marked token of the same page at or before each token, -1 if there is none."""
        at = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1)) if len(marked) else np.empty(0, np.int64)
        return np.where(at >= self.begins, at, -1)

    def _running(self, step: np.ndarray) -> np.ndarray:
        total = np.cumsum(step)
        return total - total[self.begins] + step[self.begins]

    def _levels(self, events: np.ndarray) -> np.ndarray:
        is_open, is_close = self.kind == OPEN, self.kind == CLOSE
        inline = np.isin(self.names, INLINE_TAGS)[self.name] & (is_open | is_close)
        implied, stray = np.zeros(len(self), np.int64), np.zeros(len(self), bool)
        for event, (_, _, _, nested) in zip(events.T, OPTIONAL_END):
            before = np.concatenate([[-1], self._last(event != NOTHING)[:-1]])[: len(self)]
            last = np.where(before >= self.begins, event[before], END)
            # An item still open is closed by the next item or by an enclosing end.
            implied += (last == BEGIN) & ((event == BEGIN) | (event == OUT))
            # An end tag without an open item has nothing to close.
            stray |= (event == END) & ((last == END) if nested else (last != BEGIN))
        step = np.where(inline, 0, is_open.astype(np.int64) - (is_close & ~stray)) - implied
        inline_total = self._running(inline * (is_open.astype(np.int64) - is_close))
        block = self._last((is_open | is_close) & ~inline)
        inline_level = inline_total - np.where(block >= 0, inline_total[block], 0)
        return self._running(step) + np.maximum(inline_level, 0)

    def opened(self, level: int) -> np.ndarray:
        """The element opened last on a level, up to and with each token; -1 if the page has none yet."""
        return self._last((self.kind == OPEN) & (self.level == level))

    def tagged(self, *tags: str) -> np.ndarray:
        return np.isin(self.names, tags)[self.name] & (self.kind == OPEN)

    def class_of(self, at: int) -> str:
        return self._attribute(CLASS, at)

    def href_of(self, at: int) -> str:
        return self._attribute(HREF, at)

    def _attribute(self, pattern: re.Pattern, at: int) -> str:
        found = pattern.search(self.token[at]) if "=" in self.token[at] else None
        if not found:
            return ""
        value = found[1]
        quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
        return html.unescape(value[1:-1] if quoted else value)

    def texts(self, picked: np.ndarray) -> dict[int, str]:
        """The text of the picked elements: stripped runs joined by nothing."""
        found = dict.fromkeys(np.flatnonzero(picked).tolist(), "")
        for level in np.unique(self.level[picked]).tolist():
            owner = self.opened(level)
            runs = np.flatnonzero((self.kind == TEXT) & (self.level >= level) & (owner >= 0))
            runs = runs[picked[owner[runs]]]
            of = owner[runs]
            cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))[: len(of)]
            for a, b in zip(cuts, [*cuts[1:], len(of)]):
                found[int(of[a])] = "".join(self.text[i] for i in runs[a:b].tolist())
        return found

    def parents(self, elements: np.ndarray) -> np.ndarray:
        """The element each one stands in: the last one opened a level higher, -1 if there is none."""
        found = np.full(len(elements), -1)
        for level in np.unique(self.level[elements]).tolist():
            own = self.level[elements] == level
            found[own] = self.opened(level - 1)[elements[own]]
        return found

    def holders(self, elements: np.ndarray, boxes: np.ndarray) -> list[tuple[int, int]]:
        """All pairs (box, element) of elements that stand inside a box, at any depth."""
        pairs = []
        for level in np.unique(self.level[boxes]).tolist():
            inner = elements[self.level[elements] > level]
            box = self.opened(level)[inner]
            right = (box >= 0) & boxes[box]
            pairs += zip(box[right].tolist(), inner[right].tolist())
        return pairs


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in runs of bounded markup: tokens and levels of a tree take many times the bytes of its page."""
    size = pc.fill_null(pc.binary_length(batch.column("html")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    piece = (np.cumsum(size) - size) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for first, last in zip(cuts, cuts[1:]):
        if last > first:
            yield batch.slice(first, last - first)


def in_scan(pages: DataFrame, added: T.StructType, read: Callable[[PageTree, int], list[tuple]]) -> DataFrame:
    """All columns of `pages` but the html, with those that `read(tree, number of pages)` gives for every page.

    Nothing is shuffled, but for a table too small to keep the cores busy.
    """
    own = [f for f in pages.schema.fields if f.name != "html"]
    arrow = [T.StructType([f]) for f in added.fields]
    names = [f.name for f in own] + added.fieldNames()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(s.fields[0].dataType) for s in arrow]
        tags = Tags()
        for batch in batches:
            for piece in pieces(batch):
                rows = read(PageTree(piece.column("html").to_pylist(), tags), piece.num_rows)
                columns = [pa.array(list(column), type_) for column, type_ in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([*[piece.column(f.name) for f in own], *columns], names)

    return bound_batches(spread(pages)).mapInArrow(scan, T.StructType([*own, *added.fields]))
