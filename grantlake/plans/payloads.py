"""From crawled pages to the payload each source delivers.

Every function takes ``(page_id, url, html)`` rows of served pages and returns ``(page_id, payload)`` with
the payload as JSON text, one row per page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.functions.html import page_text, title
from grantlake.functions.labels import topic_labels
from grantlake.functions.payrates import pay_rates
from grantlake.functions.text import excerpt, non_empty
from grantlake.functions.urls import resolve
from grantlake.operators.fields import with_details, with_sections
from grantlake.operators.links import INSIDE, LINK_RULES, explode_links, page_links, read_hrefs_inside
from grantlake.operators.pagetree import in_scan

PDF_SUFFIX = ".pdf"


def to_payload(**fields: Column) -> Column:
    """JSON text of an object; missing values are written as null."""
    row = F.struct(*[value.alias(name) for name, value in fields.items()])
    return F.to_json(row, {"ignoreNullFields": "false"})


def _labelled(*labels: str) -> Column:
    """The first non-empty of several labelled fields."""
    return F.coalesce(*[non_empty(F.try_element_at("fields", F.lit(label))) for label in labels])


def _with_details(pages: DataFrame) -> DataFrame:
    return with_details(pages.select("page_id", "url", title(F.col("html")).alias("title"), "html"))


def grant_payloads(pages: DataFrame) -> DataFrame:
    """Grant opportunity pages."""
    payload = to_payload(
        url=F.col("url"),
        title=F.col("title"),
        description=F.col("description"),
        agency=F.try_element_at("fields", F.lit("agency")),
        category=_labelled("category", "segment"),
        closing_date=_labelled("closing date", "close date"),
        estimated_value=_labelled("estimated total grant value", "total funding"),
        raw_fields=F.col("fields"),
    )
    return _with_details(pages).select("page_id", payload.alias("payload"))


def program_payloads(pages: DataFrame) -> DataFrame:
    """Government program pages."""
    payload = to_payload(
        url=F.col("url"),
        title=F.col("title"),
        description=F.col("description"),
        eligibility=_labelled("eligibility", "who can apply"),
        closing_date=_labelled("closing date", "close date"),
        what_you_get=_labelled("what you get", "amount"),
        raw_fields=F.col("fields"),
    )
    return _with_details(pages).select("page_id", payload.alias("payload"))


def guidance_sections(pages: DataFrame) -> DataFrame:
    """``page_id, url, title, sections, topics`` of guidance pages; sections in page order."""
    joined = with_sections(pages.select("page_id", "url", title(F.col("html")).alias("title"), "html"))
    bodies = F.array_join(F.transform("sections", lambda section: section["body"]), " ")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), bodies)
    return joined.withColumn("topics", topic_labels(text))


def guidance_payloads(pages: DataFrame) -> DataFrame:
    """Tax guidance pages."""
    entries = F.transform("sections", lambda section: F.struct(section["heading"], section["body"]))
    payload = to_payload(
        url=F.col("url"),
        title=F.col("title"),
        sections=F.map_from_entries(entries),
        topics=F.col("topics"),
    )
    return guidance_sections(pages).select("page_id", payload.alias("payload"))


def is_pdf(url: Column) -> Column:
    return F.lower(url).endswith(PDF_SUFFIX)


def award_documents(pages: DataFrame, pdf_texts: DataFrame | None = None) -> DataFrame:
    """``page_id, url, title, text`` of award documents: page text, and text already taken from PDF files.

    ``pdf_texts(page_id, url, text)``. PDF documents carry no title.
    """
    web = pages.where(~is_pdf(F.col("url"))).select(
        "page_id", "url", title(F.col("html")).alias("title"), page_text(F.col("html")).alias("text")
    )
    if pdf_texts is None:
        return web
    return web.unionByName(pdf_texts.select("page_id", "url", F.lit(None).cast("string").alias("title"), "text"))


def award_payloads(documents: DataFrame) -> DataFrame:
    """Award documents ``(page_id, url, title, text)``."""
    payload = to_payload(
        url=F.col("url"),
        title=F.col("title"),
        document_type=F.when(is_pdf(F.col("url")), "pdf").otherwise("html"),
        pay_rates=pay_rates(F.coalesce("text", F.lit(""))),
        raw_text_excerpt=excerpt(F.col("text")),
    )
    return documents.select("page_id", payload.alias("payload"))


def award_link_arrays(listing: DataFrame, base: Column | None = None) -> DataFrame:
    """`listing` without its html, with `links`: the sorted distinct document links of every award search page.

    Any link to a PDF counts, and any link inside the results block. One scan, no shuffle.
    """
    rule = LINK_RULES["fair_work_mapd"]
    origin = F.lit(rule.base) if base is None else base
    own = [c for c in listing.columns if c != "html"]
    pages = listing.withColumns({"_base": origin, "_pdf": page_links(F.col("html"), origin, rule)})
    both = in_scan(pages, INSIDE, lambda tree, n_pages: read_hrefs_inside(tree, n_pages, rule.container_class))
    resolved = F.transform("inside", lambda href: resolve(href, F.col("_base")))
    return both.select(*own, F.array_sort(F.array_union("_pdf", resolved)).alias("links"))


def award_links(listing: DataFrame, base: Column | None = None) -> DataFrame:
    """``page_id, link_ord, link`` of award search pages."""
    return explode_links(award_link_arrays(listing, base), F.col("links"))
