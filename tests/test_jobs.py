"""Ingest, process, snapshot and the incremental run over small zones."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from grantlake.functions.ids import record_id
from grantlake.plans.jobs import Snapshots, run_ingest, run_process
from grantlake.schemas import SOURCES
from grantlake.sources.zones import partition_path, read_processed, read_raw
from grantlake.streaming.incremental import run_incremental

DATE = "2026-11-02"


def line(source, payload, at="2026-11-02T00:00:00+00:00"):
    return json.dumps({"source": source, "payload": payload, "fetched_at": at})


def put(root, source, lines, date=DATE, name="records.jsonl"):
    folder = Path(partition_path(str(root), source, date))
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines), encoding="utf-8")


def statuses(report):
    return {row.source: row.status for row in report.collect()}


def payload_table(spark, *payloads):
    return spark.createDataFrame([(json.dumps(p),) for p in payloads], "payload string")


def test_ingest_writes_each_source_and_isolates_failures(spark, tmp_path):
    def broken():
        raise RuntimeError("site is down")

    sources = {s: (lambda s=s: payload_table(spark, {"url": f"https://x/{s}"})) for s in SOURCES}
    sources["ato"] = broken
    sources["data_gov_au"] = lambda: payload_table(spark).limit(0)
    report = statuses(run_ingest(spark, sources, str(tmp_path), DATE))
    assert report["grantconnect"] == "ok (1 records)"
    assert report["data_gov_au"] == "ok (0 records)"
    assert report["ato"] == "failed: site is down"
    assert read_raw(spark, str(tmp_path), "fair_work_mapd", DATE).count() == 1


def test_ingest_replaces_a_partition_even_with_nothing(spark, tmp_path):
    full = {"ato": lambda: payload_table(spark, {"url": "a"}, {"url": "b"})}
    empty = {"ato": lambda: payload_table(spark, {"url": "a"}).where(F.lit(False))}
    run_ingest(spark, full, str(tmp_path), DATE)
    assert statuses(run_ingest(spark, empty, str(tmp_path), DATE)) == {"ato": "ok (0 records)"}
    assert read_raw(spark, str(tmp_path), "ato", DATE).count() == 0


def test_process_reports_and_isolates(spark, tmp_path):
    raw, done = tmp_path / "raw", str(tmp_path / "done")
    put(raw, "grantconnect", [line("grantconnect", {"url": "u1", "title": "T"}), "", "   "])
    put(raw, "ato", [line("ato", {"url": "u"}), "{not json"])
    put(raw, "business_gov_au", [line("business_gov_au", None)])
    put(raw, "fair_work_mapd", [line("fair_work_mapd", [1, 2])])
    snapshots = Snapshots(spark, str(tmp_path / "snap"))
    report = statuses(run_process(spark, str(raw), done, snapshots, DATE))
    assert report["grantconnect"] == "ok (1 records)"
    assert report["business_gov_au"] == "ok (1 records)"
    assert report["ato"].startswith("failed: ")
    assert report["fair_work_mapd"].startswith("failed: ")
    assert report["data_gov_au"].startswith("failed: ")
    records = {r.source: r for r in snapshots.all_current().collect()}
    assert set(records) == {"grantconnect", "business_gov_au"}
    expected = spark.range(1).select(record_id(F.lit("grantconnect"), F.lit("u1"))).first()[0]
    assert records["grantconnect"].record_id == expected
    assert {r.run_date for r in read_processed(spark, done).collect()} == {DATE}


def test_unknown_source_fails_alone(spark, tmp_path):
    put(tmp_path, "ato", [line("ato", {"url": "u"})])
    report = statuses(run_process(spark, str(tmp_path), str(tmp_path / "p"), None, DATE, ["elsewhere", "ato"]))
    assert report["ato"] == "ok (1 records)"
    assert "has no field mapping" in report["elsewhere"]


def test_snapshot_keeps_last_line_and_later_batches(spark, tmp_path):
    raw = tmp_path / "raw"
    snapshots = Snapshots(spark, str(tmp_path / "snap"))
    put(raw, "ato", [line("ato", {"url": "u", "title": t}) for t in ("one", "two", "three")])
    run_process(spark, str(raw), str(tmp_path / "p"), snapshots, DATE, ["ato"])
    assert [r.title for r in snapshots.current("ato").collect()] == ["three"]
    put(raw, "ato", [line("ato", {"url": "u", "title": "four"}), line("ato", {"title": "keyless"})], "2026-11-09")
    run_process(spark, str(raw), str(tmp_path / "p"), snapshots, "2026-11-09", ["ato"])
    assert sorted(r.title for r in snapshots.current("ato").collect()) == ["four", "keyless"]


def test_json_zone_holds_nested_raw_and_nulls(spark, tmp_path):
    put(tmp_path, "ato", [line("ato", {"url": "u", "n": {"a": [1, None]}})])
    run_process(spark, str(tmp_path), str(tmp_path / "p"), None, DATE, ["ato"], form="json")
    text = spark.read.text(partition_path(str(tmp_path / "p"), "ato", DATE)).first()[0]
    row = json.loads(text)
    assert row["raw"] == {"url": "u", "n": {"a": [1, None]}}
    assert row["amount"] is None and len(row) == 12


def test_incremental_equals_batch(spark, tmp_path):
    raw = tmp_path / "raw"
    batch, stream = Snapshots(spark, str(tmp_path / "b")), Snapshots(spark, str(tmp_path / "s"))
    changes = []

    def note(source, records):
        changes.append((source, sorted(r.title for r in records.collect())))

    def run():
        run_incremental(spark, str(raw), stream, str(tmp_path / "check"), note).awaitTermination()

    put(raw, "ato", [line("ato", {"url": "u", "title": "one"}), line("ato", {"url": "v", "title": "v"})])
    put(raw, "grantconnect", [line("grantconnect", {"url": "g", "title": "g"})])
    run()
    put(raw, "ato", [line("ato", {"url": "u", "title": "two"}), line("ato", {"url": "v", "title": "v"})], "2026-11-09")
    run()
    for date in (DATE, "2026-11-09"):
        run_process(spark, str(raw), str(tmp_path / "p"), batch, date)
    as_rows = lambda s: sorted(map(tuple, s.all_current().collect()))
    assert as_rows(batch) == as_rows(stream)
    assert sorted(changes) == [("ato", ["one", "v"]), ("ato", ["two"]), ("grantconnect", ["g"])]


def test_job_files_are_packed_tightly(spark, tmp_path):
    """Texts are held several times over by the job, so its parquet files take the smaller codec."""
    put(tmp_path / "raw", "ato", [line("ato", {"url": "u", "title": "T"})])
    run_process(spark, str(tmp_path / "raw"), str(tmp_path / "done"), Snapshots(spark, str(tmp_path / "snap")), DATE, ["ato"])
    written = [p.name for folder in ("done", "snap/_work", "snap/source=ato/data") for p in (tmp_path / folder).rglob("*.parquet")]
    assert written and all(".zstd." in name for name in written)


def test_a_job_keeps_packed_raw_lines_and_no_scratch(spark, tmp_path):
    """What a source needs on the way holds all its texts, and went on lying there for every source of a run."""
    raw, snapshots = str(tmp_path / "raw"), Snapshots(spark, str(tmp_path / "snap"))
    run_ingest(spark, {s: (lambda s=s: payload_table(spark, {"url": s, "title": "T"}, {"url": s, "title": "U"})) for s in ("ato", "grantconnect")}, raw, DATE)
    files = [p.name for p in Path(raw).rglob("part-*")]
    assert files and all(name.endswith(".gz") for name in files)
    put(raw, "fair_work_mapd", ["{not json"])
    report = statuses(run_process(spark, raw, str(tmp_path / "done"), snapshots, DATE, ["ato", "grantconnect", "fair_work_mapd"]))
    assert report["ato"] == report["grantconnect"] == "ok (2 records)" and report["fair_work_mapd"].startswith("failed")
    assert sorted((r.source, r.title) for r in snapshots.all_current().collect()) == [("ato", "U"), ("grantconnect", "U")]
    assert read_processed(spark, str(tmp_path / "done")).count() == 4
    assert not list((tmp_path / "snap" / "_work").rglob("*.parquet"))
