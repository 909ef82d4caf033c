"""From crawled listing and detail pages to the raw zone: cut-off, ordered links, the page behind each link, payloads."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.operators.dedup import one_per_key
from grantlake.operators.links import LINK_RULES, page_links
from grantlake.plans.jobs import run_ingest
from grantlake.plans.payloads import award_documents, award_link_arrays, award_payloads, grant_payloads, guidance_payloads, program_payloads
from grantlake.session import stored
from grantlake.sources.pages import OK_STATUS, fetched, listing_pages, until_empty

# How a source's detail pages become payloads: `(page_id, url, html)` to `(page_id, payload)`.
PAYLOADS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "grantconnect": grant_payloads,
    "business_gov_au": program_payloads,
    "ato": guidance_payloads,
    "fair_work_mapd": lambda pages: award_payloads(award_documents(pages)),
}
# Sources whose listing is a single hub page, of which the first links are taken; the others are read page by page.
HUBS = ("ato",)
DEFAULT_PORTS = r"(?i)^(http://[^/?#]*):80(?=[/?#]|$)|^(https://[^/?#]*):443(?=[/?#]|$)"


def canonical(url: Column) -> Column:
    """One form for all ways to write a URL that fetch the same page: scheme and host in lower case, no default port, no fragment."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    ported = F.regexp_replace(bare, DEFAULT_PORTS, "$1$2")
    site = F.regexp_extract(ported, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    rest = F.substring(ported, F.length(site) + 1, F.length(ported))
    return F.concat(F.lower(site), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def link_table(listing: DataFrame, source: str, max_pages: int | None = None) -> DataFrame:
    """``page_no, position, url``: the links of `listing(page_no, url, status, html)` in the order a crawl meets them.

    Pages count up to the first one without links. Links of a page are distinct and sorted, those of different pages are not
    compared, so a repeated link stays. A listing page that failed before the end raises. Of a hub the first `max_pages`
    links of each page are taken; elsewhere `max_pages` limits the listing pages.
    """
    rule = LINK_RULES[source]
    served = F.col("status") == OK_STATUS
    if rule.container_class is None:
        found = listing.withColumn("links", page_links(F.col("html"), F.lit(rule.base), rule, max_pages if source in HUBS else None))
    else:
        found = award_link_arrays(listing)
    # Pages are read once: what follows needs their links alone.
    narrow = stored(found.select("page_no", "url", "status", F.when(served, F.col("links")).alias("links"), F.lit(source).alias("source")))
    if source not in HUBS:
        # Settled before failures are looked at: a page after the end would not have been asked for.
        narrow = stored(until_empty(narrow, F.size("links"), max_pages))
    checked = listing_pages(narrow).where(F.col("status") == OK_STATUS)
    return checked.select("page_no", F.posexplode("links").alias("pos", "link")).select(
        "page_no", (F.col("pos") + 1).alias("position"), F.col("link").alias("url")
    )


def crawl_payloads(listing: DataFrame, details: DataFrame, source: str, max_pages: int | None = None) -> DataFrame:
    """``page_no, position, url, payload`` in crawl order, from `listing` (see `link_table`) and `details(url, status, html)`.

    A link leads to the page with its canonical URL; links to pages that were not served, or never fetched, are skipped. Each
    linked page is read and turned into a payload once for every way its URL is written, however often it is linked.
    """
    links = stored(link_table(listing, source, max_pages).withColumn("key", canonical(F.col("url"))))
    pages = fetched(details).select(canonical(F.col("url")).alias("key"), F.col("url").alias("fetched_url"), "html")
    linked = pages.join(links.select("key").distinct(), "key", "left_semi")
    one_each = one_per_key(linked, ["key"], ["fetched_url", F.xxhash64("html")])
    written = one_each.join(links.select("key", "url").distinct(), "key").select(F.col("url").alias("page_id"), "url", "html")
    payloads = PAYLOADS[source](written).select(F.col("page_id").alias("url"), "payload")
    rows = links.drop("key").join(payloads, "url").select("page_no", "position", "url", "payload")
    return rows.repartitionByRange("page_no", "position").sortWithinPartitions("page_no", "position")


def ingest_crawl(
    spark: SparkSession,
    crawled: Mapping[str, Callable[[], tuple[DataFrame, DataFrame]]],
    raw_root: str,
    run_date: str | None = None,
    max_pages: int | None = None,
) -> DataFrame:
    """Write the payloads of crawled sources to the raw zone, each failing alone; returns the run report.

    ``crawled`` maps a source to a function that gives its listing and its detail pages. Raw lines stand in crawl order.
    """

    def build(source: str) -> Callable[[], DataFrame]:
        return lambda: crawl_payloads(*crawled[source](), source, max_pages).select("payload")

    return run_ingest(spark, {source: build(source) for source in crawled}, raw_root, run_date)
