"""Detail links of listing pages. One row per page in, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantlake.functions.html import ANCHOR_HREF, unquote, visible
from grantlake.functions.urls import resolve
from grantlake.operators.pagetree import OPEN, PageTree


INSIDE = T.StructType().add("inside", T.ArrayType(T.StringType()))


@dataclass(frozen=True)
class LinkRule:
    """Which anchors of a listing page lead to detail pages."""

    base: str
    href_contains: str | None = None
    url_contains: str | None = None
    self_url: str | None = None
    container_class: str | None = None


# Site origins, listing pages and link marks of the crawled sources.
LINK_RULES = {
    "grantconnect": LinkRule(base="https://www.grants.gov.au", href_contains="Go/Show"),
    "business_gov_au": LinkRule(
        base="https://business.gov.au",
        href_contains="/grants-and-programs/",
        self_url="https://business.gov.au/grants-and-programs",
    ),
    "ato": LinkRule(
        base="https://www.ato.gov.au",
        url_contains="/businesses-and-organisations/small-business",
        self_url="https://www.ato.gov.au/businesses-and-organisations/small-business",
    ),
    "fair_work_mapd": LinkRule(
        base="https://www.fwc.gov.au", href_contains=".pdf", container_class="search-results"
    ),
}


def hrefs(html: Column) -> Column:
    """Non-empty link targets of a page in document order."""
    found = F.regexp_extract_all(visible(html), F.lit(ANCHOR_HREF), F.lit(1))
    return F.filter(F.transform(found, unquote), lambda href: href != "")


def _trim_slashes(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def page_links(html: Column, base: Column, rule: LinkRule, cap: int | None = None) -> Column:
    """Sorted distinct absolute links of one page that satisfy ``rule``, optionally the first ``cap``."""
    targets = hrefs(html)
    if rule.href_contains is not None:
        targets = F.filter(targets, lambda href: F.contains(href, F.lit(rule.href_contains)))
    links = F.transform(targets, lambda href: resolve(href, base))
    if rule.url_contains is not None:
        links = F.filter(links, lambda url: F.contains(url, F.lit(rule.url_contains)))
    if rule.self_url is not None:
        links = F.filter(links, lambda url: _trim_slashes(url) != rule.self_url.rstrip("/"))
    links = F.array_sort(F.array_distinct(links))
    return links if cap is None else F.slice(links, 1, cap)


def explode_links(listing: DataFrame, links: Column) -> DataFrame:
    """Rows of a listing table with ``links`` as ``link_ord`` (from 1) and ``link``."""
    return listing.select("page_id", F.posexplode(links).alias("pos", "link")).select(
        "page_id", (F.col("pos") + 1).alias("link_ord"), "link"
    )


def read_hrefs_inside(tree: PageTree, n_pages: int, class_name: str) -> list[tuple]:
    """The distinct link targets of every page that stand inside an element whose class lists exactly `class_name`."""
    boxes = np.zeros(len(tree), bool)
    boxes[[i for i in np.flatnonzero(tree.kind == OPEN) if class_name in tree.token[i] and class_name in tree.class_of(i).split()]] = True
    inside: list[set[str]] = [set() for _ in range(n_pages)]
    for _, anchor in tree.holders(np.flatnonzero(tree.tagged("a")), boxes):
        href = tree.href_of(anchor)
        if href:
            inside[tree.page[anchor]].add(href)
    return [(sorted(hrefs),) for hrefs in inside]


def listing_links(listing: DataFrame, source: str, cap: int | None = None) -> DataFrame:
    """Links of a source's listing pages ``(page_id, html)``; not for rules that look at containers."""
    rule = LINK_RULES[source]
    return explode_links(listing, page_links(F.col("html"), F.lit(rule.base), rule, cap))
