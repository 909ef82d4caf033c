"""Raw lines, dataset search responses, normalizers and dedup."""

import json

import pytest
from pyspark.sql import functions as F

from grantlake.operators.dedup import first_wins, key_collisions, last_wins
from grantlake.operators.normalize import normalize, normalize_source, record_json
from grantlake.schemas import NORMALIZED, SOURCES
from grantlake.sources.ckan import by_search_term, dataset_payloads
from grantlake.sources.zones import envelope, parse_raw_lines, raw_lines

AT = "2026-11-02T00:00:00+00:00"


def one(spark, source, payload):
    df = spark.createDataFrame([(None if payload is None else json.dumps(payload),)], "payload string")
    record = normalize_source(envelope(df, source, F.lit(AT)), source).first()
    assert record.source == source and record.ingested_at == AT and record.record_id.startswith(f"{source}#")
    assert json.loads(record.raw) == (payload or {})
    return record


def fields(record):
    return {k: v for k, v in record.asDict().items() if k not in ("record_id", "source", "ingested_at", "raw") and v is not None}


@pytest.mark.parametrize(
    "source, payload, expected",
    [
        (
            "grantconnect",
            {"url": "u", "title": "", "category": "c", "closing_date": "31 May 2027", "estimated_value": "$5",
             "raw_fields": {"eligibility": "", "eligible applicants": "all", "location": "VIC", "state": "NSW"}},
            {"url": "u", "title": "", "category": "c", "deadline": "31 May 2027", "amount": "$5", "eligibility": "all",
             "state_or_territory": "VIC"},
        ),
        ("grantconnect", {"url": "u", "raw_fields": None}, {"url": "u"}),
        (
            "data_gov_au",
            {"id": "i", "name": "n", "title": "t", "notes": "d", "organization": {"title": "Org"}, "tags": [{"name": "x"}, {"name": "y"}]},
            {"url": "https://data.gov.au/dataset/n", "title": "t", "description": "d", "category": "x", "state_or_territory": "Org"},
        ),
        ("data_gov_au", {"id": "i", "name": "", "title": "t", "tags": ["x"], "organization": "Org"}, {"title": "t"}),
        (
            "business_gov_au",
            {"link": "l", "url": "", "summary": "s", "who_can_apply": "w", "funding_amount": "f", "closing_date": "d", "location": "QLD", "category": ""},
            {"url": "l", "description": "s", "eligibility": "w", "amount": "f", "deadline": "d", "state_or_territory": "QLD", "category": ""},
        ),
        ("business_gov_au", {}, {}),
        ("ato", {"url": "u", "content": "c", "topic": "t"}, {"url": "u", "description": "c", "category": "t"}),
        ("ato", {"url": "u", "title": "T", "sections": {"a": "b"}, "topics": ["gst"]}, {"url": "u", "title": "T"}),
        (
            "fair_work_mapd",
            {"url": "u", "award_name": "a", "summary": "s", "pay_rate": "$20", "conditions": "c", "classification": "k"},
            {"url": "u", "title": "a", "description": "s", "amount": "$20", "eligibility": "c", "category": "k"},
        ),
        ("fair_work_mapd", {"url": "u", "pay_rates": [{"amount": 1.5}]}, {"url": "u", "category": "modern_award"}),
        ("ato", None, {}),
    ],
)
def test_field_mapping(spark, source, payload, expected):
    assert fields(one(spark, source, payload)) == expected


def test_ids_depend_on_source_and_key_only(spark):
    assert one(spark, "ato", {"url": "u"}).record_id == one(spark, "ato", {"link": "u", "title": "x"}).record_id
    assert one(spark, "ato", {}).record_id == one(spark, "ato", {"url": ""}).record_id
    tails = {one(spark, s, {"url": "u"}).record_id.split("#")[1] for s in ("ato", "grantconnect")}
    assert len(tails) == 2
    assert one(spark, "data_gov_au", {"name": "n"}).record_id != one(spark, "data_gov_au", {"id": "n"}).record_id


def test_dispatch_equals_the_single_normalizers(spark):
    payload = {"url": "u", "title": "t", "description": "d", "pay_rate": "$1", "amount": "$2", "name": "n"}
    df = spark.createDataFrame([(s, json.dumps(payload)) for s in SOURCES], "s string, payload string")
    mixed = normalize(envelope(df, F.col("s"), F.lit(AT))).select(*NORMALIZED.fieldNames())
    assert sorted(mixed.collect()) == sorted(one(spark, s, payload) for s in SOURCES)


def test_unknown_source_is_an_error(spark):
    df = spark.createDataFrame([("{}",)], "payload string")
    with pytest.raises(KeyError):
        normalize_source(envelope(df, "other"), "other")
    with pytest.raises(Exception, match="no field mapping for source other"):
        normalize(envelope(df, "other")).collect()


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_raw_lines_round_trip(spark):
    text = json.dumps({"source": "ato", "payload": {"b": 1, "a": [None, "é"]}, "fetched_at": AT})
    parsed = parse_raw_lines(lines(spark, text, "", " \t "))
    back = json.loads(raw_lines(parsed).first()[0])
    assert parsed.count() == 1 and back == json.loads(text)


@pytest.mark.parametrize("bad", ["{oops", '{"source": "ato", "payload": {'])
def test_malformed_line_fails(spark, bad):
    with pytest.raises(Exception):
        parse_raw_lines(lines(spark, '{"source": "a"}', bad)).collect()


@pytest.mark.parametrize("bad", ["[1]", '"text"', "7", "true"])
def test_payload_that_is_no_object_fails(spark, bad):
    raw = parse_raw_lines(lines(spark, f'{{"source": "ato", "payload": {bad}, "fetched_at": "t"}}'))
    with pytest.raises(Exception, match="payload is not an object"):
        normalize_source(raw, "ato").collect()


@pytest.mark.parametrize("empty", ["null", "{}", "[]", '""', "0", "false"])
def test_empty_payloads_count_as_objects(spark, empty):
    raw = parse_raw_lines(lines(spark, f'{{"source": "ato", "payload": {empty}, "fetched_at": "t"}}'))
    assert normalize_source(raw, "ato").first().raw == "{}"


def test_record_json_writes_nulls(spark):
    df = spark.createDataFrame([('{"url": "u"}',)], "payload string")
    row = json.loads(record_json(normalize_source(envelope(df, "ato", F.lit(AT)), "ato")).first()[0])
    assert list(row) == NORMALIZED.fieldNames() and row["raw"] == {"url": "u"} and row["title"] is None


def responses(spark, rows, *pages):
    body = lambda ids: json.dumps({"success": True, "result": {"count": len(ids), "results": ids}})
    data = [(t, start, p if isinstance(p, str) else body([{"id": i} if i else {"title": "x"} for i in p])) for t, start, p in pages]
    found = dataset_payloads(spark.createDataFrame(data, "term_ord int, start int, body string"), rows)
    return [(r.package_id, r.term_ord, r.start, r.pos) for r in found.orderBy("term_ord", "start", "pos").collect()]


def test_dataset_pages_stop_after_the_first_short_one(spark):
    found = responses(spark, 2, (0, 0, ["a", "b"]), (0, 2, ["c"]), (0, 4, ["never", "read"]))
    assert [f[0] for f in found] == ["a", "b", "c"]


def test_dataset_dedup_keeps_the_first_term_and_drops_idless(spark):
    found = responses(spark, 3, (0, 0, ["a", None, "b"]), (0, 3, []), (1, 0, ["b", "c"]))
    assert found == [("a", 0, 0, 0), ("b", 0, 0, 2), ("c", 1, 0, 1)]


@pytest.mark.parametrize("body", ['{"success": true}', '{"result": null}', '{"result": {"results": null}}', '{"result": {}}'])
def test_responses_without_results(spark, body):
    assert responses(spark, 2, (0, 0, body)) == []


def test_dedup_orders(spark):
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early"), ("", 0, "none"), (None, 0, "none")], "id string, o int, v string")
    assert [r.v for r in first_wins(df, "id", "o").collect()] == ["early"]
    stored = spark.createDataFrame([("k", 9, "stored"), ("j", 0, "kept")], "id string, o int, v string")
    assert sorted(r.v for r in last_wins(stored, df.where("id = 'k'"), "id", "o").collect()) == ["kept", "late"]
    assert [tuple(r) for r in key_collisions(df, "id").collect()] == [("k", 2)]


def test_hot_keys_are_cut_before_the_shuffle(spark):
    df = spark.range(10).select(F.expr("cast(id % 2 as string)").alias("id"), F.col("id").alias("o"))
    text = first_wins(df, "id", "o")._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_search_terms_keep_their_order(spark):
    rows = [("compliance", 0, "b"), ("small business grants", 0, "a"), ("other", 0, "c"), (None, 0, "d")]
    found = by_search_term(spark.createDataFrame(rows, "term string, start long, body string")).collect()
    assert sorted((r.term_ord, r.body) for r in found) == [(0, "a"), (1, "b")]
    assert by_search_term(spark.createDataFrame(rows, "term string, start long, body string"), ["other"]).first().term_ord == 0
