"""Bucketed versions: which buckets an upsert writes, repeated batches, growth, change detection without text, bad lines."""

import hashlib
import json

from pyspark.sql import functions as F
from test_jobs import DATE, line, put

from grantlake.plans import snapshots as S
from grantlake.plans.snapshots import Snapshots
from grantlake.schemas import NORMALIZED
from grantlake.sources.zones import LINE_ORDER
from grantlake.streaming.incremental import run_incremental, run_reports


def records(spark, rows):
    """`(id, title)` pairs as records of one source, in line order."""
    found = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "record_id string, title string, line_order long")
    rest = [F.lit("ato").alias("source")] + [F.lit(None).cast("string").alias(c) for c in NORMALIZED.fieldNames() if c not in ("record_id", "title", "source")]
    return found.select("record_id", "title", LINE_ORDER, *rest)


def titles(snapshots):
    return {r.record_id: r.title for r in snapshots.current("ato").collect()}


def files(tmp_path, version):
    return sorted(p.name for p in (tmp_path / "source=ato" / "data" / f"version={version}").iterdir() if p.name.startswith("bucket="))


def test_an_upsert_of_one_id_rewrites_one_bucket(spark, tmp_path):
    snapshots = Snapshots(spark, str(tmp_path))
    assert snapshots.current("ato") is None and snapshots.contents("ato") is None
    written = snapshots.upsert("ato", records(spark, [(f"r{i}", "old") for i in range(200)]))
    assert written == list(range(S.LEAST_BUCKETS)) and len(files(tmp_path, 0)) == S.LEAST_BUCKETS
    assert len(snapshots.upsert("ato", records(spark, [("r7", "first"), ("r7", "last")]))) == 1
    assert len(files(tmp_path, 1)) == 1
    assert titles(snapshots) == {f"r{i}": "last" if i == 7 else "old" for i in range(200)}
    assert snapshots.upsert("ato", records(spark, []).limit(0)) == [] and len(titles(snapshots)) == 200


def test_a_repeated_batch_leaves_no_second_version(spark, tmp_path):
    snapshots = Snapshots(spark, str(tmp_path))
    snapshots.upsert("ato", records(spark, [("a", "one")]), "run#1")
    assert snapshots.upsert("ato", records(spark, [("a", "two")]), "run#1") == []
    assert titles(snapshots) == {"a": "one"} and snapshots.has_batch("ato", "run#1") and not snapshots.has_batch("ato", "run#2")
    snapshots.upsert("ato", records(spark, [("a", "two")]), "run#2")
    # Older batches are still known when newer versions exist.
    assert snapshots.upsert("ato", records(spark, [("a", "three")]), "run#1") == [] and titles(snapshots) == {"a": "two"}


def test_buckets_grow_with_the_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_RECORDS", 2)
    snapshots = Snapshots(spark, str(tmp_path))
    snapshots.upsert("ato", records(spark, [(f"r{i}", "old") for i in range(10)]))
    snapshots.upsert("ato", records(spark, [(f"r{i}", "new") for i in range(5, 90)]))
    assert titles(snapshots) == {f"r{i}": "old" if i < 5 else "new" for i in range(90)}
    assert {row.n_buckets for row in snapshots._newest("ato")} == {64}
    assert sum(row.n_records for row in snapshots._newest("ato")) == 90


def test_long_records_get_more_buckets(spark, tmp_path, monkeypatch):
    """A bucket is what one task merges, so its bytes count as its records do."""
    monkeypatch.setattr(S, "BUCKET_BYTES", 4096)
    snapshots = Snapshots(spark, str(tmp_path))
    noise = [(f"r{i}", "".join(hashlib.sha256(f"{i} {n}".encode()).hexdigest() for n in range(60))) for i in range(500)]
    snapshots.upsert("ato", records(spark, noise[:40]))
    first = {row.n_buckets for row in snapshots._newest("ato")}
    snapshots.upsert("ato", records(spark, noise))
    second = {row.n_buckets for row in snapshots._newest("ato")}
    assert min(first) > S.LEAST_BUCKETS and min(second) > min(first)
    assert titles(snapshots) == dict(noise)


def test_change_detection_reads_no_text(spark, tmp_path):
    snapshots = Snapshots(spark, str(tmp_path))
    snapshots.upsert("ato", records(spark, [("a", "one"), ("b", "two")]))
    plan = snapshots.contents("ato")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<record_id:string,content:string>" in plan
    found = S.changed_since(snapshots.contents("ato"), records(spark, [("a", "one"), ("b", "2"), ("c", "3")]))
    assert {r.record_id for r in found.collect()} == {"b", "c"}


def test_a_bad_line_stops_its_source_alone(spark, tmp_path):
    raw, root = tmp_path / "raw", tmp_path / "snap"
    put(raw, "ato", [line("ato", {"url": "u", "title": "T"}), "{not json"])
    put(raw, "grantconnect", [line("grantconnect", {"url": "g", "title": "G"}), "", "  "])
    snapshots = Snapshots(spark, str(root))

    def run():
        run_incremental(spark, str(raw), snapshots, str(tmp_path / "check")).awaitTermination()
        return {r.source: r.status for r in run_reports(snapshots).collect()}

    found = run()
    assert found["grantconnect"] == "ok (1 records)" and found["ato"].startswith("failed: ")
    assert snapshots.current("ato") is None and snapshots.current("grantconnect").count() == 1
    aside = spark.read.text(str(root / "_quarantine" / "source=ato")).collect()
    assert {r.value for r in aside} == {line("ato", {"url": "u", "title": "T"}), "{not json"}
    put(raw, "ato", [line("ato", {"url": "u", "title": "T"})], DATE, "mended.jsonl")
    run()
    assert [r.title for r in snapshots.current("ato").collect()] == ["T"] and json.dumps(DATE)
