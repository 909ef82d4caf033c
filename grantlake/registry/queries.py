"""One query per operator, each over whole tables. ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.functions import labels
from grantlake.functions.html import page_text, title
from grantlake.functions.ids import record_id
from grantlake.functions.text import record_text, snippet
from grantlake.functions.typed import amount_value, deadline_date
from grantlake.functions.urls import origin
from grantlake.functions.vectors import cosine_similarity
from grantlake.operators.dedup import first_wins, key_collisions, last_wins
from grantlake.operators.embed import VectorStore, chunks, fill_embeddings
from grantlake.operators.fields import descriptions, labelled_fields, sections
from grantlake.operators.joins import join_per_key
from grantlake.operators.keyword_index import keyword_index_topk as index_topk
from grantlake.operators.links import LinkRule, explode_links, hrefs, listing_links, page_links
from grantlake.operators.normalize import normalize, normalize_source, record_json
from grantlake.operators.rank import DEFAULT_TOP_K
from grantlake.operators.retrieve import chunk_topk, cosine_topk, keyword_scores, keyword_topk, term_frequencies
from grantlake.operators.vector_index import VectorIndex, recall
from grantlake.plans.answers import agents_used, answer_questions, answer_questions_by_embedding, prompts, questions_with_hits
from grantlake.plans.ingest import ingest_crawl, link_table
from grantlake.plans.jobs import run_ingest, run_process
from grantlake.plans.payloads import (
    award_documents,
    award_links,
    award_payloads,
    grant_payloads,
    guidance_payloads,
    guidance_sections,
    program_payloads,
)
from grantlake.plans.snapshots import Snapshots
from grantlake.registry import inputs
from grantlake.registry.inputs import FETCHED_AT, table
from grantlake.schemas import SOURCES
from grantlake.session import new_folder, stored
from grantlake.sources.ckan import SEARCH_TERMS, by_search_term, dataset_payloads
from grantlake.sources.pages import fetched, until_empty
from grantlake.sources.zones import LINE_ORDER, envelope, parse_raw_lines, partition_path, raw_lines, read_processed, read_raw, write_raw
from grantlake.streaming.incremental import changed

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
RUN_DATE = "2026-11-02"


def query(build: Query) -> Query:
    REGISTRY[build.__name__] = build
    return build


@query
def record_ids(spark, sf_dir):
    doc = table(spark, sf_dir, "documents")
    return doc.select("doc_id", record_id(F.col("source"), F.nullif(F.col("lang"), F.lit("es"))).alias("record_id"))


@query
def record_text_snippet(spark, sf_dir):
    records = inputs.document_records(spark, sf_dir)
    return records.select("record_id", record_text().alias("record_text"), snippet(F.col("description")).alias("snippet"))


@query
def tokenize_tf(spark, sf_dir):
    return term_frequencies(table(spark, sf_dir, "documents"), "doc_id", "text")


@query
def keyword_score_pairs(spark, sf_dir):
    """Score each reply of a conversation against the turn before it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    scored = keyword_scores(turns.join(before, ["conv_id", "turn"]), "question", "text")
    return scored.select("conv_id", "turn", "score")


@query
def keyword_retrieve_topk(spark, sf_dir):
    records = inputs.document_records(spark, sf_dir).select("record_id", "ord", record_text().alias("text"))
    return keyword_topk(inputs.user_questions(spark, sf_dir), records)


@query
def keyword_index_topk(spark, sf_dir):
    """The same ranking by a stored index of the records."""
    records = inputs.document_records(spark, sf_dir).select("record_id", "ord", record_text().alias("text"))
    return index_topk(inputs.user_questions(spark, sf_dir), records)


def _vectors(spark, sf_dir):
    """The mean of each label as a question, and all vectors as records."""
    questions = inputs.label_centroids(spark, sf_dir).withColumnRenamed("label", "question_id")
    vectors = table(spark, sf_dir, "embeddings")
    return questions, vectors.select(F.col("vec_id").cast("string").alias("record_id"), F.col("vec_id").alias("ord"), "embedding")


@query
def cosine_lsh_topk(spark, sf_dir):
    """The approximate ranking, with each question's recall against the exact one."""
    questions, records = _vectors(spark, sf_dir)
    questions = stored(questions)
    found = VectorIndex.build(records).topk(questions)
    shares = recall(found, cosine_topk(questions, records))
    hits = found.join(shares, "question_id")
    return hits.select("question_id", "rank", "record_id", F.round("score", 6).alias("score"), F.round("recall", 3).alias("recall"))


@query
def cosine_retrieve_topk(spark, sf_dir):
    hits = cosine_topk(*_vectors(spark, sf_dir))
    return hits.select("question_id", "rank", "record_id", F.round("score", 6).alias("score"))


@query
def cosine_score_pairs(spark, sf_dir):
    """Similarity of every vector to the mean of its label."""
    centroids = inputs.label_centroids(spark, sf_dir).withColumnRenamed("embedding", "mean")
    pairs = join_per_key(table(spark, sf_dir, "embeddings"), centroids, "label")
    return pairs.select("vec_id", F.round(cosine_similarity(F.col("embedding"), F.col("mean")), 6).alias("score"))


@query
def classify_question(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", labels.question_class(F.col("text")).alias("classification"))


@query
def route_agents(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.array_join(agents_used(F.col("text")), ",").alias("agents_used"))


@query
def keyword_cascade(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", labels.first_label(F.col("text")).alias("label"))


@query
def topic_labels(spark, sf_dir):
    doc = table(spark, sf_dir, "documents")
    return doc.select("doc_id", F.array_join(labels.topic_labels(F.col("text")), ",").alias("topics"))


def _answers(spark, sf_dir):
    return answer_questions(inputs.user_questions(spark, sf_dir), inputs.document_records(spark, sf_dir))


@query
def answer_questions_table(spark, sf_dir):
    return _answers(spark, sf_dir).select(
        "question_id",
        "classification",
        "answer",
        F.size("citations").alias("n_citations"),
        F.array_join("agents_used", ",").alias("agents_used"),
        "is_mock",
    )


@query
def answers_without_hits(spark, sf_dir):
    """Questions without a word or, in every second turn of a user, with one that no record has."""
    asked = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    asked = asked.withColumn("question_id", F.concat_ws("-", "conv_id", "turn"))
    unknown = F.concat(F.lit("Qz"), F.md5(F.col("question_id")), F.lit("?"))
    question = F.when(F.col("turn") % 4 == 0, unknown).otherwise(F.regexp_replace("text", "[A-Za-z0-9]", ""))
    answers = answer_questions(asked.select("question_id", question.alias("question")), inputs.document_records(spark, sf_dir))
    return answers.select("question_id", "classification", "answer", F.size("citations").alias("n_citations"), "is_mock")


@query
def citations(spark, sf_dir):
    cited = _answers(spark, sf_dir).select("question_id", F.posexplode("citations").alias("pos", "citation"))
    return cited.select("question_id", (F.col("pos") + 1).alias("rank"), "citation.*")


@query
def prompt_context(spark, sf_dir):
    questions, records = inputs.user_questions(spark, sf_dir), inputs.document_records(spark, sf_dir)
    return prompts(questions_with_hits(questions, records)).drop("question")


@query
def generated_answers(spark, sf_dir):
    """Answers written by a hook in place of the templates; the stand-in reports what it was given."""

    def count_lines(question: pd.Series, context: pd.Series) -> pd.Series:
        return question.str.len().astype(str) + "/" + context.str.count("\n- ").add(1).astype(str)

    answers = answer_questions(
        inputs.user_questions(spark, sf_dir), inputs.document_records(spark, sf_dir), generate=count_lines
    )
    return answers.select("question_id", "answer")


@query
def answers_with_shared_ids(spark, sf_dir):
    """All records of a source share one id and none has a place, as pages without a natural key do."""
    shared = inputs.document_records(spark, sf_dir).drop("ord").withColumn("record_id", record_id(F.col("source"), F.lit(None).cast("string")))
    answers = answer_questions(inputs.user_questions(spark, sf_dir), shared)
    cited = answers.select("question_id", F.posexplode("citations").alias("pos", "citation"))
    return cited.select("question_id", (F.col("pos") + 1).alias("rank"), "citation.record_id", "citation.title", "citation.url")


@query
def answer_questions_embedding(spark, sf_dir):
    """Answers ranked by vectors of letter counts; those of English records are in the store before."""

    def letters(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(text.count(letter)) for letter in "aeinot"] for text in texts])

    records = inputs.document_records(spark, sf_dir)
    vectors = VectorStore(spark, new_folder(spark, "vectors"))
    vectors.fill(records.where("lang = 'en'").select("record_id", "ord", record_text().alias("text")), letters)
    answers = answer_questions_by_embedding(inputs.user_questions(spark, sf_dir), records, vectors, letters)
    return answers.select("question_id", "classification", "answer", F.size("citations").alias("n_citations"), F.array_join("agents_used", ",").alias("agents_used"), "is_mock")


@query
def chunk_retrieve_topk(spark, sf_dir):
    """Documents by their best chunk."""
    doc = table(spark, sf_dir, "documents")
    records = doc.select(F.col("doc_id").cast("string").alias("record_id"), F.col("doc_id").alias("ord"), "text")
    return chunk_topk(inputs.user_questions(spark, sf_dir), records)


@query
def cosine_guards(spark, sf_dir):
    """Vectors against the mean of their label: three of four labels have theirs emptied, cut short or set to zero."""
    centroids = inputs.label_centroids(spark, sf_dir).withColumnRenamed("embedding", "mean")
    kind, own = F.col("label") % 4, F.col("embedding").cast("array<double>")
    spoilt = F.when(kind == 0, F.slice(own, 1, 0)).when(kind == 1, F.slice(own, 1, 10)).when(kind == 2, F.transform(own, lambda x: x * 0)).otherwise(own)
    pairs = join_per_key(table(spark, sf_dir, "embeddings"), centroids, "label")
    return pairs.select("vec_id", F.round(cosine_similarity(spoilt, F.col("mean")), 6).alias("score"))


@query
def raw_zone_files(spark, sf_dir):
    """Documents as raw files of one source and date: French ones without a payload, Spanish ones after a blank line."""
    root = new_folder(spark, "zone")
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    payloads = inputs.raw_payloads(spark, sf_dir, "ato").join(lang, "doc_id")
    payload = F.when(F.col("lang") != "fr", F.col("payload")).otherwise("null")
    write_raw(envelope(payloads.select(payload.alias("payload")), "ato", F.lit(FETCHED_AT)), root, "ato", RUN_DATE)
    blank = lang.where("lang = 'es'").select(F.when(F.col("doc_id") % 2 == 0, " \t").otherwise("").alias("value"))
    blank.write.mode("append").text(partition_path(root, "ato", RUN_DATE))
    return normalize_source(read_raw(spark, root, "ato", RUN_DATE), "ato").select("record_id", "title", "url", "ingested_at")


@query
def job_report(spark, sf_dir):
    """What the ingest and process jobs report over files they wrote, and how many records the snapshots hold."""
    root = new_folder(spark, "jobs")
    payloads = {s: lambda s=s: inputs.raw_payloads(spark, sf_dir, s).select("payload") for s in SOURCES}
    snapshots = Snapshots(spark, f"{root}/snapshots")
    reports = run_ingest(spark, payloads, f"{root}/raw", RUN_DATE).unionByName(
        run_process(spark, f"{root}/raw", f"{root}/processed", snapshots, RUN_DATE)
    )
    held = snapshots.all_current().groupBy("source").agg(F.count(F.lit(1)).alias("n_current"))
    read = read_processed(spark, f"{root}/processed").groupBy("source").agg(F.count(F.lit(1)).alias("n_processed"))
    return reports.drop("error").join(held, "source").join(read, "source")


@query
def snapshot_upsert(spark, sf_dir):
    """Two crawls into the snapshots, the second of the long documents alone, each twice with another title."""
    snapshots = Snapshots(spark, new_folder(spark, "snapshots"))
    records = normalize_source(_raw(spark, sf_dir, "grantconnect"), "grantconnect")
    order = F.struct(F.lit("crawl").alias("file"), F.col("doc_id").alias("row"))
    snapshots.upsert("grantconnect", records.withColumn(LINE_ORDER, order), "first")
    again = records.where(F.length("description") >= 1000).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    titled = again.withColumn("title", F.concat(F.lit("Crawl "), F.col("n").cast("string"), F.lit(": "), F.col("title")))
    later = titled.withColumn(LINE_ORDER, F.struct(F.lit("crawl").alias("file"), (2 * F.col("doc_id") + F.col("n")).alias("row")))
    for _ in range(2):
        snapshots.upsert("grantconnect", later, "second")
    return snapshots.current("grantconnect").select("record_id", "title", "url")


@query
def award_documents_of_both_kinds(spark, sf_dir):
    """Crawled pages as award pages, and documents as text already taken from PDF files."""
    doc = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://awards.example.org/"), F.col("doc_id").cast("string"), F.lit(".PDF"))
    pdf = doc.select(F.col("doc_id").alias("page_id"), url.alias("url"), "text")
    payloads = award_payloads(award_documents(table(spark, sf_dir, "pages"), pdf))
    return _payload_fields(payloads, "url", "title", "document_type", "raw_text_excerpt")


@query
def raw_envelope_roundtrip(spark, sf_dir):
    payload = F.to_json(F.struct("doc_id", "text", F.struct("lang", "n_chars").alias("about"))).alias("payload")
    payloads = table(spark, sf_dir, "documents").select("source", payload)
    back = parse_raw_lines(raw_lines(envelope(payloads, F.col("source"), F.lit(FETCHED_AT))))
    return back.select(
        F.variant_get("payload", "$.doc_id", "long").alias("doc_id"),
        F.variant_get("payload", "$.text", "string").alias("text"),
        F.variant_get("payload", "$.about.lang", "string").alias("lang"),
        "source",
        "fetched_at",
    )


def _raw(spark, sf_dir, source):
    return envelope(inputs.raw_payloads(spark, sf_dir, source), source, F.lit(FETCHED_AT))


def _normalized(source: str) -> Query:
    def build(spark, sf_dir):
        return normalize_source(_raw(spark, sf_dir, source), source)

    build.__name__ = f"normalize_{source}"
    return build


for _source in SOURCES:
    query(_normalized(_source))


def _all_raw(spark, sf_dir):
    raw = _raw(spark, sf_dir, SOURCES[0])
    for source in SOURCES[1:]:
        raw = raw.unionByName(_raw(spark, sf_dir, source))
    return raw


@query
def normalize_dispatch(spark, sf_dir):
    return normalize(_all_raw(spark, sf_dir)).drop("raw")


@query
def processed_json(spark, sf_dir):
    lines = record_json(normalize(_all_raw(spark, sf_dir)))
    names = ("record_id", "source", "title", "amount", "deadline", "category", "url", "ingested_at")
    # Lines are long, so the fields of one are read in one pass.
    return lines.select(F.json_tuple("value", *names).alias(*names), F.get_json_object("value", "$.raw.title").alias("raw_title"))


@query
def typed_fields(spark, sf_dir):
    records = inputs.document_records(spark, sf_dir)
    return records.select(
        "record_id",
        amount_value(F.col("amount")).cast("double").alias("amount_value"),
        F.date_format(deadline_date(F.col("deadline")), "yyyy-MM-dd").alias("deadline_date"),
    )


@query
def upsert_last_wins(spark, sf_dir):
    """Events keyed by user: views are the stored state, everything else arrives as a batch."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    is_view = F.col("event_type") == "view"
    stored = last_wins(None, events.where(is_view), "user_id", "event_id")
    return last_wins(stored, events.where(~is_view), "user_id", "event_id")


@query
def key_collision_report(spark, sf_dir):
    raw = _raw(spark, sf_dir, "ato")
    return key_collisions(normalize_source(raw, "ato"))


@query
def changed_records(spark, sf_dir):
    """Two crawls of the same documents, the second with the long ones rewritten."""
    old = normalize_source(_raw(spark, sf_dir, "grantconnect"), "grantconnect")
    title_now = F.when(F.length("description") >= 1000, F.concat(F.lit("New: "), "title")).otherwise(F.col("title"))
    return changed(old, old.withColumn("title", title_now)).select("record_id", "title")


@query
def first_wins_dedup(spark, sf_dir):
    """Events as search hits: the type gives the search term, errors carry no package id."""
    order = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    hits = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "error", "").otherwise(F.col("user_id").cast("string")).alias("package_id"),
        order.alias("term_ord"),
        F.to_date("ts").alias("page"),
        F.col("event_id").alias("pos"),
    )
    return first_wins(hits, "package_id", "term_ord", "page", "pos").select("package_id", "term_ord", "pos")


@query
def ckan_flatten(spark, sf_dir):
    responses = inputs.dataset_responses(spark, sf_dir)
    term = F.when(F.col("term_ord") == 0, SEARCH_TERMS[0]).otherwise(SEARCH_TERMS[1])
    found = dataset_payloads(by_search_term(responses.select(term.alias("term"), "start", "body")))
    records = normalize_source(envelope(found, "data_gov_au", F.lit(FETCHED_AT)), "data_gov_au")
    fields = ("record_id", "title", "description", "category", "state_or_territory", "url")
    return records.select(*fields, "package_id", "term_ord", "start", "pos")


@query
def run_report(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_records"))
    status = F.concat(F.lit("ok ("), F.col("n_records").cast("string"), F.lit(" records)"))
    return counts.select("source", "n_records", status.alias("status"))


@query
def status_filter(spark, sf_dir):
    """Pages whose host starts with m. stand for failed fetches."""
    status = F.when(F.col("url").rlike("^https?://m\\."), 404).otherwise(200)
    return fetched(table(spark, sf_dir, "pages").withColumn("status", status)).select("page_id", "url")


@query
def paging_cutoff(spark, sf_dir):
    """Pages of a host in id order, up to the first without a link below ``/th``."""
    pages = table(spark, sf_dir, "pages")
    n_links = F.size(F.filter(hrefs(F.col("html")), lambda href: href.startswith("/th")))
    listing = pages.select(origin(F.col("url")).alias("source"), F.col("page_id").alias("page_no"), n_links.alias("n_links"))
    return until_empty(listing, F.col("n_links")).select("source", "page_no", "n_links")


@query
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", title(F.col("html")).alias("title"))


@query
def page_text_lines(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page_text(F.col("html")).alias("text"))


@query
def page_links_resolved(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return explode_links(pages, page_links(F.col("html"), origin(F.col("url")), LinkRule(base="")))


@query
def page_description(spark, sf_dir):
    doc = table(spark, sf_dir, "documents")
    html = F.concat(
        F.lit('<body><p class="intro">x<br><p>y<div class="page-summary wide"><b> '),
        F.col("lang"),
        F.lit(":</b> "),
        inputs.escape_html(F.col("text")),
        F.lit('<!-- note --></div><div class="description">late</div>'),
    )
    return descriptions(doc.select(F.col("doc_id").alias("page_id"), html.alias("html")))


@query
def page_description_of_leaves(spark, sf_dir):
    """Spanish pages have an empty element of a summary class before their description."""
    doc = table(spark, sf_dir, "documents")
    leaf = F.when(F.col("lang") == "es", '<img alt="" class="page-summary">').otherwise('<hr class="rule">')
    html = F.concat(F.lit("<body>"), leaf, F.lit('<div class="description">'), inputs.escape_html(F.col("text")), F.lit("</div>"))
    return descriptions(doc.select(F.col("doc_id").alias("page_id"), html.alias("html")))


@query
def links_grant_listing(spark, sf_dir):
    return listing_links(inputs.listing_pages(spark, sf_dir, "Go/Show?GoUuid=", "/Go/List"), "grantconnect")


@query
def links_program_listing(spark, sf_dir):
    home = "https://business.gov.au/grants-and-programs/"
    return listing_links(inputs.listing_pages(spark, sf_dir, "/grants-and-programs/", home), "business_gov_au")


@query
def links_guidance_hub(spark, sf_dir):
    path = "/businesses-and-organisations/small-business"
    return listing_links(inputs.listing_pages(spark, sf_dir, f"{path}/", path), "ato", cap=3)


@query
def links_award_search(spark, sf_dir):
    return award_links(inputs.search_pages(spark, sf_dir))


def _ingested(spark, sf_dir, source, crawl, max_pages=None):
    """The raw rows that a crawl leaves in the raw zone."""
    root = new_folder(spark, "zone")
    report = ingest_crawl(spark, {source: lambda: crawl(spark, sf_dir)}, root, RUN_DATE, max_pages).first()
    if report["error"]:
        raise RuntimeError(report["error"])
    return read_raw(spark, root, source, RUN_DATE).select(F.to_json("payload").alias("payload"))


@query
def ingest_grantconnect(spark, sf_dir):
    rows = _ingested(spark, sf_dir, "grantconnect", inputs.grant_crawl)
    names = ("url", "title", "agency", "category", "closing_date", "estimated_value")
    return rows.select(*[F.get_json_object("payload", f"$.{name}").alias(name) for name in names])


@query
def ingest_ato(spark, sf_dir):
    """The first ten guides of every hub page."""
    rows = _ingested(spark, sf_dir, "ato", inputs.guidance_crawl, 10)
    paths = {"url": "$.url", "title": "$.title", "overview": "$.sections.Overview", "topics": "$.topics"}
    return rows.select(*[F.get_json_object("payload", path).alias(name) for name, path in paths.items()])


@query
def crawl_order(spark, sf_dir):
    """The links of all listing pages up to the end of the listing, in order and with repeats."""
    listing, _ = inputs.grant_crawl(spark, sf_dir)
    return link_table(listing, "grantconnect")


@query
def labelled_page_fields(spark, sf_dir):
    return labelled_fields(inputs.part_pages(spark, sf_dir))


def _payload_fields(payloads: DataFrame, *names: str, **paths: str) -> DataFrame:
    """The named top-level payload fields, and the ones at other JSON paths."""
    paths = {**{name: f"$.{name}" for name in names}, **paths}
    return payloads.select("page_id", *[F.get_json_object("payload", path).alias(name) for name, path in paths.items()])


@query
def grant_page_payloads(spark, sf_dir):
    payloads = grant_payloads(inputs.part_pages(spark, sf_dir))
    names = ("url", "title", "description", "agency", "category", "closing_date", "estimated_value")
    return _payload_fields(payloads, *names)


@query
def program_page_payloads(spark, sf_dir):
    payloads = program_payloads(inputs.part_pages(spark, sf_dir))
    return _payload_fields(payloads, "url", "title", "description", "eligibility", "closing_date", "what_you_get")


@query
def page_sections(spark, sf_dir):
    return sections(inputs.guidance_pages(spark, sf_dir)).drop("pos")


@query
def guidance_topics(spark, sf_dir):
    pages = guidance_sections(inputs.guidance_pages(spark, sf_dir))
    return pages.select("page_id", "title", F.size("sections").alias("n_sections"), F.array_join("topics", ",").alias("topics"))


@query
def guidance_page_payloads(spark, sf_dir):
    payloads = guidance_payloads(inputs.guidance_pages(spark, sf_dir))
    return _payload_fields(payloads, "url", "title", "topics", overview="$.sections.Overview")


@query
def pay_rates(spark, sf_dir):
    payloads = award_payloads(inputs.award_pages(spark, sf_dir))
    shape = "array<struct<classification:string,amount:double,period:string>>"
    rates = F.from_json(F.get_json_object("payload", "$.pay_rates"), shape)
    return payloads.select("page_id", F.posexplode(rates).alias("pos", "rate")).select("page_id", "pos", "rate.*")


@query
def award_page_payloads(spark, sf_dir):
    payloads = award_payloads(inputs.award_pages(spark, sf_dir))
    return _payload_fields(payloads, "url", "title", "document_type", "raw_text_excerpt")


@query
def embedding_cache_fill(spark, sf_dir):
    """Documents without a stored vector are embedded by a stand-in; stored vectors are kept."""

    def length_and_words(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(len(text)), float(text.count(" "))] for text in texts])

    doc = table(spark, sf_dir, "documents")
    records = doc.select(F.col("doc_id").cast("string").alias("record_id"), F.col("doc_id").alias("ord"), "text")
    vectors = table(spark, sf_dir, "embeddings")
    known = vectors.select(F.col("vec_id").cast("string").alias("record_id"), "embedding")
    filled = fill_embeddings(records, known, length_and_words)
    return filled.select(
        "record_id", F.size("embedding").alias("n_values"), F.round(F.col("embedding")[0], 6).alias("first_value")
    )


@query
def record_chunks(spark, sf_dir):
    records = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("record_id"), "text")
    return chunks(records)


def flagship(spark: SparkSession, sf_dir: str, k: int = DEFAULT_TOP_K) -> DataFrame:
    """Answers with citations for every user turn, over all documents as normalized records."""
    return answer_questions(inputs.user_questions(spark, sf_dir), inputs.document_records(spark, sf_dir), k)
