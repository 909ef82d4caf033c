"""The crawl as tables: order and repeats of links, the end of a listing, failed pages, ways to write a URL, the raw zone."""

import json

import pytest
from pyspark.sql import functions as F
from test_jobs import DATE, statuses

from grantlake.plans.ingest import canonical, crawl_payloads, ingest_crawl, link_table
from grantlake.sources.zones import LINE_ORDER, read_raw

SITE = "https://www.grants.gov.au"


def anchors(*names):
    return "".join(f'<a href="/Go/Show?{n}">x</a>' for n in names)


def listing(spark, *pages):
    rows = [(n, f"{SITE}/Go/List?page={n}", status, html) for n, status, html in pages]
    return spark.createDataFrame(rows, "page_no long, url string, status int, html string")


def details(spark, *pages):
    return spark.createDataFrame(list(pages), "url string, status int, html string")


def table(df):
    return sorted(map(tuple, df.select("page_no", "position", "url").collect()))


def test_links_keep_order_and_repeats(spark):
    pages = listing(spark, (2, 200, anchors("c", "a", "a")), (1, 200, anchors("b", "a")), (3, 200, "<p>end"), (4, 200, anchors("z")), (5, 500, ""))
    show = f"{SITE}/Go/Show?"
    expected = [(1, 1, f"{show}a"), (1, 2, f"{show}b"), (2, 1, f"{show}a"), (2, 2, f"{show}c")]
    assert table(link_table(pages, "grantconnect")) == expected
    assert table(link_table(pages, "grantconnect", 1)) == expected[:2]


def test_a_failed_listing_page_before_the_end_raises(spark):
    pages = listing(spark, (1, 200, anchors("a")), (2, 503, anchors("b")), (3, 200, anchors("c")), (4, 200, ""))
    with pytest.raises(Exception, match="listing page failed: .*page=2"):
        link_table(pages, "grantconnect").collect()
    assert table(link_table(pages, "grantconnect", 1)) == [(1, 1, f"{SITE}/Go/Show?a")]


@pytest.mark.parametrize(
    "url, same",
    [
        ("HTTPS://WWW.Grants.gov.au:443/Go/Show?A#top", f"{SITE}/Go/Show?A"),
        ("http://x.org:80", "http://x.org/"),
        ("http://x.org:8080/a", "http://x.org:8080/a"),
        ("https://x.org:80/a/", "https://x.org:80/a/"),
        (" http://X.org?q=B ", "http://x.org/?q=B"),
    ],
)
def test_canonical_urls(spark, url, same):
    assert spark.createDataFrame([(url,)], "u string").select(canonical(F.col("u"))).first()[0] == same


def test_details_are_joined_by_canonical_url(spark):
    pages = listing(spark, (1, 200, anchors("a", "b", "c#x", "c#y", "gone")), (2, 200, anchors("a")), (3, 200, ""))
    found = crawl_payloads(
        pages,
        details(
            spark,
            ("HTTPS://www.grants.gov.au/Go/Show?a", 200, "<h1>A"),
            (f"{SITE}/Go/Show?b", 404, "<h1>B"),
            (f"{SITE}/Go/Show?c", 200, "<h1>C"),
            (f"{SITE}/Go/Show?c", 200, "<h1>C"),
            (f"{SITE}/Go/Show?unlinked", 200, "<h1>U"),
        ),
        "grantconnect",
    ).collect()
    got = [(r.page_no, r.position, json.loads(r.payload)["title"], json.loads(r.payload)["url"].split("?")[1]) for r in found]
    assert got == [(1, 1, "A", "a"), (1, 3, "C", "c#x"), (1, 4, "C", "c#y"), (2, 1, "A", "a")]


def test_crawls_reach_the_raw_zone_and_fail_alone(spark, tmp_path):
    good = listing(spark, (1, 200, anchors("b", "a")), (2, 200, anchors("a")))
    served = details(spark, (f"{SITE}/Go/Show?a", 200, "<h1>A"), (f"{SITE}/Go/Show?b", 200, "<h1>B"))
    hub = '<a href="/businesses-and-organisations/small-business/gst">g</a><a href="/businesses-and-organisations/small-business/b">b</a>'
    hubs = spark.createDataFrame([(1, "https://www.ato.gov.au/x", 200, hub)], "page_no long, url string, status int, html string")
    guide = details(spark, ("https://www.ato.gov.au/businesses-and-organisations/small-business/b", 200, "<h1>B guide</h1><h2>H</h2><p>x"))
    awards = listing(spark, (1, 200, '<div class="search-results"><a href="/doc/1">d</a></div>'), (2, 200, ""))
    award = details(spark, ("https://www.fwc.gov.au/doc/1", 200, "<h1>Award</h1><p>Level 1 $20.50 per hour</p>"))
    crawled = {
        "grantconnect": lambda: (good, served),
        "business_gov_au": lambda: (listing(spark, (1, 500, "")), served),
        "ato": lambda: (hubs, guide),
        "fair_work_mapd": lambda: (awards, award),
    }
    report = statuses(ingest_crawl(spark, crawled, str(tmp_path), DATE))
    assert report["grantconnect"] == "ok (3 records)" and report["ato"] == "ok (1 records)" and report["fair_work_mapd"] == "ok (1 records)"
    assert report["business_gov_au"].startswith("failed: ") and "listing page failed" in report["business_gov_au"]
    rows = read_raw(spark, str(tmp_path), "grantconnect", DATE).orderBy(LINE_ORDER).select(F.to_json("payload").alias("p")).collect()
    assert [json.loads(r.p)["title"] for r in rows] == ["A", "B", "A"]
    (guide_row,) = read_raw(spark, str(tmp_path), "ato", DATE).select(F.to_json("payload").alias("p")).collect()
    assert json.loads(guide_row.p)["sections"] == {"H": "x"}
