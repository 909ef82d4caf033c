"""Tables of crawled pages: which rows count, and where a paged listing ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.operators.joins import join_per_key
from grantlake.session import stored

OK_STATUS = 200


def fetched(pages: DataFrame) -> DataFrame:
    """Detail pages that were served; any other status is skipped."""
    return pages.where(F.col("status") == OK_STATUS)


def listing_pages(pages: DataFrame) -> DataFrame:
    """Listing pages; a failed one is an error, because paging cannot go on without it."""
    failed = F.raise_error(F.concat(F.lit("listing page failed: "), F.col("url")))
    checked = F.when(F.col("status") == OK_STATUS, F.col("status")).otherwise(failed)
    return pages.withColumn("status", checked)


def until_empty(listing: DataFrame, n_links: Column, max_pages: int | None = None) -> DataFrame:
    """Keep each source's listing pages before the first one without links.

    ``listing(source, page_no, ...)``. The first empty page per source is a map-side combined
    minimum; the pages themselves stay in place.
    """
    if max_pages is not None:
        listing = listing.where(F.col("page_no") <= max_pages)
    empty = F.min(F.when(n_links == 0, F.col("page_no")))
    cuts = stored(listing.groupBy("source").agg(empty.alias("first_empty")))
    kept = join_per_key(listing, cuts, "source")
    return kept.where(F.col("first_empty").isNull() | (F.col("page_no") < F.col("first_empty"))).drop("first_empty")
