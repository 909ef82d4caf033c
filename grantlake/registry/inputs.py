"""Input tables in the shapes the operators expect, each derived from the given parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.functions.ids import record_id
from grantlake.session import spread

FETCHED_AT = "2026-11-02T00:00:00.000000+00:00"
RECORD_SITE = "https://records.example.org/"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the text fields of a record; some are null, some empty."""
    doc = table(spark, sf_dir, "documents")
    lang, n_chars, doc_id = F.col("lang"), F.col("n_chars"), F.col("doc_id").cast("string")
    return doc.select(
        "doc_id",
        "source",
        "lang",
        "n_chars",
        F.concat(F.upper(lang), F.lit(" notice "), doc_id).alias("title"),
        F.col("text").alias("description"),
        F.when(lang != "fr", F.concat(F.lit("Readers of "), lang)).alias("eligibility"),
        F.when(n_chars >= 1000, F.concat(F.lit("$"), n_chars.cast("string"))).otherwise("").alias("amount"),
        F.when(lang == "en", "31 December 2026").when(lang == "de", "2027-03-15").alias("deadline"),
        F.when(lang == "es", "").otherwise(lang).alias("category"),
        F.when(n_chars < 2000, F.col("source")).alias("state_or_territory"),
        F.concat(F.lit(RECORD_SITE), doc_id).alias("url"),
    )


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as normalized records in document order."""
    fields = document_fields(spark, sf_dir)
    return fields.withColumn("record_id", record_id(F.col("source"), F.col("url"))).withColumn("ord", F.col("doc_id"))


def user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a question."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return turns.select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each embedding label: ``label, embedding``."""
    values = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "value"))
    means = values.groupBy("label", "pos").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy("label").agg(F.transform(ordered, lambda at: at["mean"]).alias("embedding"))


def raw_payloads(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Every document as a payload of ``source``, with missing keys, empty values and alternate keys."""
    d = spread(document_fields(spark, sf_dir))
    lang, long_text = F.col("lang"), F.col("n_chars") >= 1000
    link = F.when(lang != "es", F.col("url"))
    fields: dict[str, list[Column]] = {
        "grantconnect": [
            F.col("url"),
            "title",
            "description",
            "category",
            F.col("deadline").alias("closing_date"),
            F.col("amount").alias("estimated_value"),
            F.struct(
                F.when(lang == "en", "").otherwise(F.col("eligibility")).alias("eligibility"),
                F.concat(F.lit("applicants in "), F.col("source")).alias("eligible applicants"),
                F.col("state_or_territory").alias("state"),
            ).alias("raw_fields"),
        ],
        "data_gov_au": [
            F.when(lang != "de", F.col("doc_id").cast("string")).alias("id"),
            F.when(long_text, F.concat(F.lit("set-"), F.col("doc_id").cast("string"))).alias("name"),
            "title",
            F.col("description").alias("notes"),
            F.struct(F.col("source").alias("title")).alias("organization"),
            F.when(lang == "fr", F.array().cast("array<struct<name:string>>"))
            .otherwise(F.array(F.struct(F.col("lang").alias("name")), F.struct(F.lit("second").alias("name"))))
            .alias("tags"),
        ],
        "business_gov_au": [
            F.when(long_text, "").otherwise(F.col("url")).alias("url"),
            link.alias("link"),
            "title",
            F.when(lang == "en", F.col("description")).otherwise("").alias("description"),
            F.when(lang != "en", F.col("description")).alias("summary"),
            F.col("eligibility").alias("who_can_apply"),
            "amount",
            F.lit("see page").alias("funding_amount"),
            F.col("deadline").alias("closing_date"),
            "category",
            F.col("state_or_territory").alias("location"),
        ],
        "ato": [
            link.alias("url"),
            "title",
            F.when(long_text, F.col("description")).alias("summary"),
            F.col("description").alias("content"),
            F.col("category").alias("category"),
            F.lit("general").alias("topic"),
        ],
        "fair_work_mapd": [
            link.alias("link"),
            F.when(long_text, "").otherwise(F.col("title")).alias("title"),
            F.concat(F.lit("award "), F.col("doc_id").cast("string")).alias("award_name"),
            F.col("description").alias("summary"),
            F.col("amount").alias("pay_rate"),
            F.col("eligibility").alias("conditions"),
            F.when(lang == "en", F.lit("clerks")).otherwise("").alias("classification"),
        ],
    }
    return d.select("doc_id", F.to_json(F.struct(*fields[source])).alias("payload"))


def dataset_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as saved search responses of up to a hundred packages: ``term_ord, start, body``.

    Term 0 finds the documents that are not English (short pages), term 1 finds all.
    """
    d = table(spark, sf_dir, "documents")
    found = d.where(F.col("lang") != "en").withColumn("term_ord", F.lit(0)).unionByName(d.withColumn("term_ord", F.lit(1)))
    package = F.struct(
        F.col("doc_id"),
        F.struct(
            F.col("doc_id").cast("string").alias("id"),
            F.concat(F.lit("set-"), F.col("doc_id").cast("string")).alias("name"),
            F.concat(F.lit("Dataset "), F.col("doc_id").cast("string")).alias("title"),
            F.col("text").alias("notes"),
            F.struct(F.col("source").alias("title")).alias("organization"),
            F.array(F.struct(F.col("lang").alias("name"))).alias("tags"),
        ).alias("package"),
    )
    start = (F.floor(F.col("doc_id") / 100) * 100).cast("long").alias("start")
    pages = found.groupBy("term_ord", start).agg(F.array_sort(F.collect_list(package)).alias("found"))
    result = F.struct(
        F.size("found").alias("count"), F.transform("found", lambda entry: entry["package"]).alias("results")
    )
    return pages.select("term_ord", "start", F.to_json(F.struct(F.lit(True).alias("success"), result.alias("result"))).alias("body"))


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as grant detail pages with a definition list and a table: ``page_id, url, html``."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey").cast("string")
    html = F.concat(
        F.lit("<html><head><title>part</title></head><body><h1> Part <b>"), key, F.lit("</b></h1>"),
        F.lit('<div class="lead description">A <em>'), F.col("p_name"), F.lit("</em> of "), F.col("p_type"), F.lit("</div>"),
        F.lit("<dl><dt>Agency:</dt><dd> "), F.col("p_brand"), F.lit(" </dd><dt>Eligibility</dt><dt>Who can apply:</dt><dd>"),
        F.col("p_type"), F.lit(" <b>only</b></dd><dt>Total Funding<dd>$"), F.col("p_size").cast("string"),
        F.lit("<dt>Agency<dd>"), F.col("p_name"), F.lit("</dl>"),
        F.lit("<table><tr><th>Agency</th><td>ignored</td></tr><tr><td>Close date:</td><td>"), F.col("p_size").cast("string"),
        F.lit(" May 2027</td></tr><tr><td>Close date</td><td>later</td></tr><tr><td>Category</td><td> </td></tr>"),
        F.lit("<tr><td>Segment<td>"), F.col("p_type"), F.lit("<tr><td>a</td><td>b</td><td>c</td></tr></table></body></html>"),
    )
    return p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://grants.example.org/"), key).alias("url"), html.alias("html"))


def guidance_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as guidance pages with headed sections: ``page_id, url, html``."""
    d = table(spark, sf_dir, "documents")
    text = escape_html(F.col("text"))
    html = F.concat(
        F.lit("<body><h1>Guide "), F.col("doc_id").cast("string"), F.lit("</h1><p>intro</p><div><h2>Overview</h2><p>"), text,
        F.lit("</p>stray<ul><li>for <b>"), F.col("lang"), F.lit("</b><li>"), F.col("source"), F.lit("</ul><h3>Empty</h3><h2>GST and <i>super</i></h2>"),
        F.lit("<p>Written in "), F.col("lang"), F.when(F.col("lang") == "de", " with payg and super").otherwise(""), F.lit("<p>Length "), F.col("n_chars").cast("string"),
        F.lit("<h2>Overview</h2><p>Last word</p></div><h2>Outside</h2></body>"),
    )
    url = F.concat(F.lit("https://guides.example.org/"), F.col("doc_id").cast("string"))
    return d.select(F.col("doc_id").alias("page_id"), url.alias("url"), html.alias("html"))


def award_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as award documents: ``page_id, url, title, text``, half of the types as PDF text."""
    p = table(spark, sf_dir, "part")
    key, price = F.col("p_partkey").cast("string"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    pdf = F.col("p_type").isin("ECONOMY", "SMALL", "STANDARD")
    text = F.concat(
        F.lit("Rates from July. "), F.col("p_name"), F.lit(" $"), price, F.lit(" per hour\n"),
        F.lit("Level "), F.col("p_size").cast("string"), F.lit(" - $"), F.col("p_size").cast("string"), F.lit(".5 PER  week; "),
        F.lit("Casual: $1,234.50 per hour\n"), F.col("p_brand"), F.lit("\n(senior):$"), F.col("p_size").cast("string"), F.lit(" per annum"),
    )
    suffix = F.when(pdf, ".PDF").otherwise("")
    return p.select(
        F.col("p_partkey").alias("page_id"),
        F.concat(F.lit("https://awards.example.org/"), key, suffix).alias("url"),
        F.when(~pdf, F.concat(F.lit("Award "), key)).alias("title"),
        text.alias("text"),
    )


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages as award search pages: the link list becomes the results block, a PDF link follows it."""
    p = table(spark, sf_dir, "pages")
    listed = F.replace(F.col("html"), F.lit("<ul>"), F.lit('<ul class="plain search-results">'))
    pdf = F.concat(
        F.lit('<footer><a href="files/'), F.col("page_id").cast("string"), F.lit('.pdf?x=1">file</a><a href="/other">no</a>')
    )
    return p.select("page_id", F.regexp_replace(listed, "<footer>", pdf).alias("html"))


def listing_pages(spark: SparkSession, sf_dir: str, prefix: str, home: str) -> DataFrame:
    """Crawled pages whose ``/th...`` links lead below ``prefix``, with one link to ``home`` at the end of the list."""
    p = table(spark, sf_dir, "pages")
    moved = F.replace(F.col("html"), F.lit('href="/th'), F.lit(f'href="{prefix}th'))
    return p.select("page_id", F.replace(moved, F.lit("</ul>"), F.lit(f'<li><a href="{home}">home</a></ul>')).alias("html"))


def grant_crawl(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as a crawl of grant pages: listing pages of 25 links each and the detail pages behind them.

    Every listing page also repeats the first link of the one before. An empty page ends the listing; one more follows it. Every
    seventh detail page failed, and all were fetched under another way to write their URL.
    """
    key = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("key"))
    page = F.floor(F.col("key") / 25).cast("long")
    again = key.where("key % 25 = 0").select((page + 1).alias("page_no"), "key")
    anchors = F.concat(F.lit('<a class="x" href="/Go/Show?GoUuid='), F.col("key").cast("string"), F.lit('">grant</a>'))
    body = F.concat(F.lit("<body><ul>"), F.array_join(F.collect_list(anchors), ""), F.lit('</ul><a href="/Go/List">next</a>'))
    listed = key.select(page.alias("page_no"), "key").unionByName(again).groupBy("page_no").agg(body.alias("html"))
    last = key.agg(F.max(page).alias("last"))
    empty = last.select((F.col("last") + 2).alias("page_no"), F.lit("<body>No more</body>").alias("html"))
    after = last.select((F.col("last") + 3).alias("page_no"), F.lit('<a href="/Go/Show?GoUuid=1">late</a>').alias("html"))
    pages = listed.unionByName(empty).unionByName(after)
    url = F.concat(F.lit("https://www.grants.gov.au/Go/List?page="), F.col("page_no").cast("string"))
    listing = pages.select("page_no", url.alias("url"), F.lit(200).alias("status"), "html")
    fetched_url = F.concat(F.lit("HTTPS://WWW.grants.gov.au:443/Go/Show?GoUuid="), F.col("page_id").cast("string"), F.lit("#top"))
    status = F.when(F.col("page_id") % 7 == 0, 404).otherwise(200)
    return listing, part_pages(spark, sf_dir).select(fetched_url.alias("url"), status.alias("status"), "html")


def guidance_crawl(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as guidance pages behind hub pages of 50 links each."""
    path = "/businesses-and-organisations/small-business"
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 50).cast("long").alias("page_no"))
    anchors = F.concat(F.lit(f'<a href="{path}/'), F.col("doc_id").cast("string"), F.lit('">guide</a>'))
    body = F.concat(F.lit(f'<a href="{path}">home</a>'), F.array_join(F.collect_list(anchors), ""))
    hubs = d.groupBy("page_no").agg(body.alias("html"))
    listing = hubs.select("page_no", F.lit(f"https://www.ato.gov.au{path}").alias("url"), F.lit(200).alias("status"), "html")
    url = F.concat(F.lit(f"https://www.ato.gov.au{path}/"), F.col("page_id").cast("string"))
    return listing, guidance_pages(spark, sf_dir).select(url.alias("url"), F.lit(200).alias("status"), "html")
