"""Page structure: labelled fields, sections, descriptions, links and payloads."""

import json
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grantlake.operators import fields
from grantlake.operators.links import listing_links
from grantlake.operators.pagetree import PageTree
from grantlake.plans import payloads
from grantlake.sources.pages import fetched, listing_pages, until_empty


def pages(spark, *html):
    rows = [(i, f"https://x.example/{i}", h) for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def labels(spark, html):
    return {r.label: r.value for r in fields.labelled_fields(pages(spark, html)).collect()}


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<dl><dt>Agency:</dt><dd>Dept of X</dd><dt> CLOSE  date::</dt><dd>May</dd></dl>", {"agency": "Dept of X", "close  date": "May"}),
        ("<dl><dt>A</dt><dt>B</dt><dd>shared</dd></dl>", {"a": "shared", "b": "shared"}),
        ("<dl><dt>A</dt><dd>1</dd><dt>A</dt><dd></dd></dl>", {"a": ""}),
        ("<dl><dt>A</dt><dd>Up to<b>20</b>staff</dd></dl>", {"a": "Up to20staff"}),
        ("<dl><div><dt>A</dt></div><div><dt>B</dt><dd>2</dd></div></dl>", {"b": "2"}),
        ("<dl><dt>A<dd>1<dt>B<dd>2</dl>", {"a": "1", "b": "2"}),
        ("<dl><dt>X</dt><dd>pre<dl><dt>in</dt><dd>i</dd></dl>post</dd></dl>", {"x": "preinipost", "in": "i"}),
        ("<table><tr><th>K:</th><td>v</td></tr><tr><td>K</td><td>w</td></tr></table>", {"k": "v"}),
        ("<table><tr><td>a</td><td>b</td><td>c</td></tr><tr><td>d</td></tr><tr><td></td><td>e</td></tr><tr><td>f</td><td> </td></tr></table>", {}),
        ("<dl><dt>K</dt><dd></dd></dl><table><tr><td>K</td><td>row</td></tr></table>", {"k": ""}),
        ("<table><tr><td>k<td>v<tr><td>m<td>w</table>", {"k": "v", "m": "w"}),
        ("<table><tr><td><table><tr><td>n</td><td>m</td></tr></table></td><td>z</td></tr></table>", {"n": "m"}),
        ("<p>open<p><b>bold<dl><dt>A</dt><!-- <dd>no</dd> --><dd>x &amp; y</dd></dl>", {"a": "x & y"}),
        ("<dt>A</dt><script>'<dd>s</dd>'</script><dd>t</dd>", {"a": "t"}),
        ("<p>nothing</p>", {}),
    ],
)
def test_labelled_fields(spark, html, expected):
    assert labels(spark, html) == expected


def sections_of(spark, html):
    found = sorted(fields.sections(pages(spark, html)).collect(), key=lambda r: r.pos)
    return [(r.heading, r.body) for r in found]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<h1>T</h1><p>i</p><h2>A</h2><p>one <b>two</b></p><ul><li>x</li></ul><h2>B</h2><p>y</p>", [("A", "onetwo x"), ("B", "y")]),
        ("<h2>A</h2><p>1</p><h3>S</h3><p>2</p><h1>stop</h1><p>3</p>", [("A", "1"), ("S", "2")]),
        ("<h2>A</h2>bare text<h2></h2><p>x</p><h3>E</h3>", []),
        ("<h2>A</h2><p>1</p><h2>B</h2><p>2</p><h2>A</h2><p>3</p>", [("A", "3"), ("B", "2")]),
        ("<div><h2>A</h2></div><p>outside</p>", []),
        ("<h2>A</h2><p>un<p>closed<div><p>in</div><a>l</a>", [("A", "un closed in l")]),
        ("<div><h2>A</h2><div><h3>N</h3><p>n</p></div><p>t</p></div>", [("A", "Nn t"), ("N", "n")]),
    ],
)
def test_sections(spark, html, expected):
    assert sections_of(spark, html) == expected


def test_description_is_the_first_match_in_page_order(spark):
    found = fields.descriptions(
        pages(
            spark,
            '<p class="intro">x</p><div class="page-summary a"> s <i>t</i></div><p class="description">d</p>',
            '<span class=description></span><p class="summary">late</p>',
            "<p>description</p>",
            "<ul class='my summary'><li>a<li>b</ul>c",
        )
    )
    assert {r.page_id: r.description for r in found.collect()} == {0: "st", 3: "ab"}


def links(spark, source, *html, cap=None):
    out = {}
    for row in sorted(listing_links(pages(spark, *html), source, cap).collect()):
        out.setdefault(row.page_id, []).append(row.link)
    return out


def test_links_of_each_listing(spark):
    html = '<a href="/Go/Show?b=1&amp;c">x</a><a href="/Go/Show?a">y</a><a href="/Go/Show?a">z</a><a href="/Go/List">l</a>'
    root = "https://www.grants.gov.au/Go/Show"
    assert links(spark, "grantconnect", html) == {0: [f"{root}?a", f"{root}?b=1&c"]}
    html = '<a href="/grants-and-programs/a">1</a><a href="/grants-and-programs/">self</a><a class=x href=\'/grants-and-programs/b\'>2</a>'
    root = "https://business.gov.au/grants-and-programs"
    assert links(spark, "business_gov_au", html) == {0: [f"{root}/a", f"{root}/b"]}
    hub = "/businesses-and-organisations/small-business"
    html = f'<a href="/contact">c</a><a href="{hub}">self</a><a href="{hub}#top">t</a><a href="{hub}/gst">g</a><a>no href</a>'
    root = f"https://www.ato.gov.au{hub}"
    assert links(spark, "ato", html, "<p>none</p>") == {0: [f"{root}#top", f"{root}/gst"]}
    assert links(spark, "ato", html, cap=1) == {0: [f"{root}#top"]}


def test_award_links_take_pdfs_and_the_results_block(spark):
    html = (
        '<a href="/nav">n</a><div class="x search-results"><ul><li><a href="/doc/1">d</a><li><a href="/p.PDF">p</a></ul></div>'
        '<a href="files/a.pdf?x=1">f</a><div class="my-search-results"><a href="/no">no</a></div>'
    )
    found = payloads.award_links(pages(spark, html, '<a href="/only.pdf">o</a>'))
    got = [(r.page_id, r.link_ord, r.link) for r in sorted(found.collect())]
    root = "https://www.fwc.gov.au"
    assert got == [(0, 1, f"{root}/doc/1"), (0, 2, f"{root}/files/a.pdf?x=1"), (0, 3, f"{root}/p.PDF"), (1, 1, f"{root}/only.pdf")]


def payload(df):
    return {r.page_id: json.loads(r.payload) for r in df.collect()}


def test_detail_payloads(spark):
    html = (
        "<h1>Grant</h1><div class=description>About</div><dl><dt>Segment</dt><dd>S</dd><dt>Category</dt><dd></dd>"
        "<dt>Close date</dt><dd>May</dd><dt>Who can apply</dt><dd>all</dd><dt>Amount</dt><dd>$5</dd></dl>"
    )
    grant = payload(payloads.grant_payloads(pages(spark, html, "<p>bare</p>")))
    assert grant[0]["category"] == "S" and grant[0]["closing_date"] == "May" and grant[0]["agency"] is None
    assert grant[0]["raw_fields"]["category"] == "" and grant[0]["title"] == "Grant" and grant[0]["description"] == "About"
    assert grant[1] == {
        "url": "https://x.example/1", "title": None, "description": None, "agency": None, "category": None,
        "closing_date": None, "estimated_value": None, "raw_fields": {},
    }
    program = payload(payloads.program_payloads(pages(spark, html)))[0]
    assert (program["eligibility"], program["what_you_get"]) == ("all", "$5")


def test_guidance_payload(spark):
    html = "<h1>GST basics</h1><h2>Register</h2><p>Over $75,000</p><h2>Records</h2><p>Record keeping for five years</p>"
    found = payload(payloads.guidance_payloads(pages(spark, html, "<h1>Super</h1>")))
    assert found[0]["sections"] == {"Register": "Over $75,000", "Records": "Record keeping for five years"}
    assert found[0]["topics"] == ["gst", "record_keeping"]
    assert found[1]["sections"] == {} and found[1]["topics"] == ["superannuation"]


def test_award_payloads_from_pages_and_pdf_text(spark):
    web = spark.createDataFrame([(1, "https://a/award", "<h1>Award</h1><p>Level 1 $20.50 per hour</p>")], "page_id long, url string, html string")
    pdf = spark.createDataFrame([(2, "https://a/b.PDF", "Grade 2 - $900 per week"), (3, "https://a/c.pdf", "")], "page_id long, url string, text string")
    found = payload(payloads.award_payloads(payloads.award_documents(web, pdf)))
    assert found[1]["title"] == "Award" and found[1]["document_type"] == "html"
    assert found[1]["pay_rates"] == [{"classification": "Level 1", "amount": 20.5, "period": "hour"}]
    assert found[1]["raw_text_excerpt"] == "Award\nLevel 1 $20.50 per hour"
    assert found[2]["pay_rates"] == [{"classification": "Grade 2", "amount": 900.0, "period": "week"}]
    assert found[2]["title"] is None and found[2]["document_type"] == "pdf"
    assert found[3]["raw_text_excerpt"] is None and found[3]["pay_rates"] == []


def test_status_and_paging(spark):
    rows = [("a", 1, 200, 3), ("a", 2, 200, 0), ("a", 3, 200, 5), ("b", 1, 200, 1), ("b", 2, 404, 1)]
    df = spark.createDataFrame(rows, "source string, page_no int, status int, n int").withColumn("url", F.lit("u"))
    kept = lambda d: sorted((r.source, r.page_no) for r in d.collect())
    assert kept(fetched(df)) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    assert kept(until_empty(df, F.col("n"))) == [("a", 1), ("b", 1), ("b", 2)]
    assert kept(until_empty(df, F.col("n"), max_pages=1)) == [("a", 1), ("b", 1)]
    with pytest.raises(Exception, match="listing page failed: u"):
        listing_pages(df).select("status").collect()


def test_structure_takes_no_shuffle_and_one_scan(spark):
    page = pages(spark, "<h1>T</h1><dl><dt>a<dd>b</dl><h2>S</h2><p>x").repartition(2).cache()
    plans = [fields.labelled_fields(page), fields.descriptions(page), fields.sections(page), payloads.grant_payloads(page),
             payloads.guidance_payloads(page), payloads.award_links(page)]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("MapInArrow ") == 1 and "EvalPython" not in text and "Join" not in text
        # The pages are dealt out once, because these few would keep one core busy; no key is shuffled by.
        assert text.count("InMemoryTableScan") == 1 and "hashpartitioning" not in text.split("InMemoryTableScan")[0]


def test_void_elements_count_as_descriptions(spark):
    found = fields.descriptions(
        pages(
            spark,
            '<img class="summary-icon"><div class="description">Real</div>',
            '<div class="summary"/><p class="summary">late</p>',
            '<br class="x"><p class="summary">text</p>',
            "<p class='a&#32;summary'>coded</p>",
        )
    )
    assert {r.page_id: r.description for r in found.collect()} == {2: "text", 3: "coded"}


def test_trees_of_many_pages_do_not_mix():
    one = "<div><p>a<p>b<ul><li>c<li>d</ul></div><b>x<table><tr><td>e<td>f</table>"
    alone = PageTree([one])
    many = PageTree([None, one, "", "<p>", one, "</p></li>", one])
    for number in (1, 4, 6):
        own = many.page == number
        assert many.level[own].tolist() == alone.level.tolist()
        assert [t for t, o in zip(many.text, own) if o] == alone.text
    assert len(PageTree([])) == 0 and len(PageTree([None, ""])) == 0


def test_large_pages_take_linear_time():
    rows = "".join(f"<tr><td>k{i}<td>v{i}</tr>" for i in range(20_000))
    html = f"<table>{rows}</table><dl>" + "".join(f"<dt>t{i}<dd>w{i}" for i in range(20_000)) + "</dl>"
    began = time.perf_counter()
    ((description, found),) = fields.read_details(PageTree([html]), 1)
    assert description is None and len(found) == 40_000 and dict(found)["t19999"] == "w19999"
    assert time.perf_counter() - began < 20


def test_award_labels_equal_pages_by_themselves(spark):
    """Batches of one page and of many give the same rows."""
    html = [f"<dl><dt>A{i}<dd>{i}</dl><table><tr><th>B<td>{i}</table>" * (i % 3) for i in range(40)]
    together = {(r.page_id, r.label, r.value) for r in fields.labelled_fields(pages(spark, *html).coalesce(1)).collect()}
    single = {(i, label, value) for i, h in enumerate(html) for label, value in fields.read_details(PageTree([h]), 1)[0][1]}
    assert together == single


def test_trees_are_built_of_bounded_pieces(spark, monkeypatch):
    """A task's trees hold few pages at a time, whatever the batch holds; no page is lost, empty ones and long ones neither."""
    from grantlake.operators import pagetree

    monkeypatch.setattr(pagetree, "PIECE_BYTES", 100)
    pages = [None, "", "x" * 1000, *["<p>" + "y" * 40] * 9, "", "z" * 99, None]
    parts = list(pagetree.pieces(pa.RecordBatch.from_arrays([pa.array(pages)], ["html"])))
    held = [part.column("html").to_pylist() for part in parts]
    assert [page for piece in held for page in piece] == pages
    assert all(sum(len(page or "") for page in piece[:-1]) < 100 for piece in held) and len(held) > 5
    assert list(pagetree.pieces(pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["html"]))) == []
