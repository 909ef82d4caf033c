"""Saved dataset-search responses: flatten, stop at the last page, drop repeats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlake.functions.payload import truthy
from grantlake.operators.dedup import first_wins
from grantlake.operators.joins import join_per_key
from grantlake.schemas import CKAN_BODY_DDL
from grantlake.session import stored

# Default search terms, in search order, and the page size.
SEARCH_TERMS = ("small business grants", "compliance")
PAGE_ROWS = 100


def by_search_term(responses: DataFrame, terms: Sequence[str] = SEARCH_TERMS) -> DataFrame:
    """Responses ``(term, start, body)`` of the given search terms with ``term_ord``, their place among them; others are left out."""
    places = F.array(*[F.lit(term) for term in terms])
    found = responses.withColumn("term_ord", F.array_position(places, F.col("term")).cast("int") - 1)
    return found.where("term_ord >= 0").drop("term")


def with_results(responses: DataFrame) -> DataFrame:
    """Add the parsed ``results`` array of each response ``body``; null at either level means no results."""
    body = F.from_json("body", CKAN_BODY_DDL, {"mode": "FAILFAST"})
    results = F.coalesce(body["result"]["results"], F.array().cast("array<variant>"))
    return responses.withColumn("results", results)


def complete_pages(responses: DataFrame, rows: int = PAGE_ROWS) -> DataFrame:
    """Keep each term's pages up to and including the first one with fewer than ``rows`` results.

    ``responses(term_ord, start, results)``. The cut is one number per term, found with a
    map-side combined minimum; the packages themselves are not shuffled for it.
    """
    short = F.min(F.when(F.size("results") < rows, F.col("start")))
    cuts = stored(responses.groupBy("term_ord").agg(short.alias("cut")))
    kept = join_per_key(responses, cuts, "term_ord")
    return kept.where(F.col("cut").isNull() | (F.col("start") <= F.col("cut"))).drop("cut")


def packages(responses: DataFrame) -> DataFrame:
    """One row per package: ``term_ord, start, pos, package_id, payload``."""
    exploded = responses.select("term_ord", "start", F.posexplode("results").alias("pos", "payload"))
    return exploded.withColumn("package_id", truthy(F.col("payload"), "$.id"))


def unique_packages(found: DataFrame) -> DataFrame:
    """The first appearance of each package in (term, page, position) order; packages without id are dropped."""
    return first_wins(found, "package_id", "term_ord", "start", "pos")


def dataset_payloads(responses: DataFrame, rows: int = PAGE_ROWS) -> DataFrame:
    """Responses ``(term_ord, start, body)`` to the ordered payload rows of the dataset source."""
    return unique_packages(packages(complete_pages(with_results(responses), rows)))
