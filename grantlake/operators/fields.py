"""Labelled fields, descriptions and sections of detail pages, read from the element tree in the scan."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantlake.functions.text import non_empty
from grantlake.operators.pagetree import LEAF, OPEN, PageTree, in_scan

DESCRIPTION_CLASSES = ("description", "summary")
TERM_TAGS = ("dt", "dd")
CELL_TAGS = ("td", "th")
SECTION_TAGS = ("h2", "h3")
SECTION_ENDS = ("h1", "h2", "h3")
MARKUP_OF_DETAILS = "(?i)<(?:d[td]|t[dh])\\b|" + "|".join(DESCRIPTION_CLASSES)

DETAILS = T.StructType().add("description", T.StringType()).add("fields", T.MapType(T.StringType(), T.StringType()))
SECTION = T.StructType().add("pos", T.IntegerType()).add("heading", T.StringType()).add("body", T.StringType())
SECTIONS = T.StructType().add("sections", T.ArrayType(SECTION))


def normal_label(text: str) -> str:
    """A label in comparable form: lower case, no colons at the end. The text is already stripped."""
    return text.lower().rstrip(":")


def first_descriptions(tree: PageTree) -> np.ndarray:
    """The first element of each page whose class names a description or summary; void elements count, and have no text."""
    named = [i for i in np.flatnonzero((tree.kind == OPEN) | (tree.kind == LEAF)).tolist() if "=" in tree.token[i]]
    named = [i for i in named if any(c in tree.class_of(i) for c in DESCRIPTION_CLASSES)]
    at = np.array(named, np.int64)
    return at[np.unique(tree.page[at], return_index=True)[1]] if len(at) else at


def _siblings(tree: PageTree, elements: np.ndarray) -> list[list[int]]:
    """The elements in groups of one page, level and parent, each in page order."""
    key = (tree.page[elements], tree.level[elements], tree.parents(elements))
    order = np.lexsort((elements, *key[::-1]))
    groups: list[list[int]] = []
    before = None
    for i, *own in zip(elements[order].tolist(), *(k[order].tolist() for k in key)):
        if own != before:
            groups.append([])
            before = own
        groups[-1].append(i)
    return groups


def read_details(tree: PageTree, n_pages: int) -> list[tuple]:
    """Description and labelled fields of every page.

    Each term goes with the next `dd` among its siblings, and the last one of a label counts. Rows of exactly two cells, both
    not empty, fill labels that no term has, and the first one counts.
    """
    terms, values, cells = tree.tagged(*TERM_TAGS), tree.tagged("dd"), tree.tagged(*CELL_TAGS)
    described = first_descriptions(tree)
    picked = terms | cells
    picked[described[tree.kind[described] == OPEN]] = True
    text = tree.texts(picked)
    fields: list[dict[str, str]] = [{} for _ in range(n_pages)]
    last: dict[tuple[int, str], int] = {}
    for group in _siblings(tree, np.flatnonzero(terms)):
        value = None
        for i in reversed(group):
            if values[i]:
                value = text[i]
            elif value is not None:
                key = (int(tree.page[i]), normal_label(text[i]))
                if i > last.get(key, -1):
                    last[key] = i
                    fields[key[0]][key[1]] = value
    rows: dict[int, list[int]] = {}
    for row, cell in tree.holders(np.flatnonzero(cells), tree.tagged("tr")):
        rows.setdefault(row, []).append(cell)
    for row in sorted(rows):
        if len(rows[row]) == 2:
            label, value = (text[i] for i in sorted(rows[row]))
            label = normal_label(label)
            if label and value:
                fields[tree.page[row]].setdefault(label, value)
    descriptions = {int(tree.page[i]): text.get(i) or None for i in described.tolist()}
    return [(descriptions.get(n), list(fields[n].items())) for n in range(n_pages)]


def with_details(pages: DataFrame) -> DataFrame:
    """`pages` without its html, with `description` (null if empty) and `fields`, a label to value map, for every page."""
    return in_scan(pages, DETAILS, read_details)


def descriptions(pages: DataFrame) -> DataFrame:
    """``page_id, description`` for pages that have a non-empty one."""
    likely = pages.where(F.col("html").rlike("(?i)class\\s*=") & F.col("html").rlike("|".join(DESCRIPTION_CLASSES)))
    found = with_details(likely.select("page_id", "html"))
    return found.select("page_id", non_empty(F.col("description")).alias("description")).where("description IS NOT NULL")


def labelled_fields(pages: DataFrame) -> DataFrame:
    """``page_id, label, value`` of detail pages."""
    likely = pages.where(F.col("html").rlike(MARKUP_OF_DETAILS)).select("page_id", "html")
    return with_details(likely).select("page_id", F.explode("fields").alias("label", "value"))


def read_sections(tree: PageTree, n_pages: int) -> list[tuple]:
    """The sections of every page: each heading with the text of its following siblings, up to the next h1, h2 or h3 among them.

    Headings without text or body are dropped; of equal headings the last body counts, at the place of the first.
    """
    found: list[dict[str, list]] = [{} for _ in range(n_pages)]
    heads, ends = tree.tagged(*SECTION_TAGS), tree.tagged(*SECTION_ENDS)
    levels = {(p, n) for p, n in zip(tree.page[heads].tolist(), tree.level[heads].tolist())}
    beside = np.flatnonzero((tree.kind == OPEN) & np.isin(tree.level, tree.level[heads]))
    beside = beside[np.array([x in levels for x in zip(tree.page[beside].tolist(), tree.level[beside].tolist())], bool)]
    # Only groups that hold a heading matter.
    groups = [g for g in _siblings(tree, beside) if heads[g].any()]
    picked = np.zeros(len(tree), bool)
    for group in groups:
        picked[group] = True
    text = tree.texts(picked)
    parts: list[tuple[int, str, str]] = []
    for group in groups:
        head, bodies = None, []
        for i in [*group, None]:
            if i is None or ends[i]:
                if head is not None and heads[head] and text[head] and bodies:
                    parts.append((head, text[head], " ".join(bodies)))
                head, bodies = i, []
            elif text[i]:
                bodies.append(text[i])
    for pos, heading, body in sorted(parts):
        own = found[tree.page[pos]].setdefault(heading, [pos - int(tree.begins[pos]), heading, body])
        own[2] = body
    return [(sorted(map(tuple, own.values())),) for own in found]


def with_sections(pages: DataFrame) -> DataFrame:
    """`pages` without its html, with `sections`, an array of pos, heading and body in page order, for every page."""
    return in_scan(pages, SECTIONS, read_sections)


def sections(pages: DataFrame) -> DataFrame:
    """``page_id, pos, heading, body``: each heading with the text of its following siblings."""
    headed = pages.where(F.col("html").rlike("(?i)<h[23]\\b")).select("page_id", "html")
    return with_sections(headed).select("page_id", F.inline("sections"))
