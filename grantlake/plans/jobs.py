"""Batch jobs over the zones. Sources run one after another and fail alone."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from grantlake.operators.normalize import check_source, normalize_source
from grantlake.plans.snapshots import Snapshots
from grantlake.schemas import REPORT, SOURCES
from grantlake.session import drop_folder, stored
from grantlake.sources.zones import default_run_date, envelope, read_raw, write_processed, write_raw


def _counted(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Run a write and return its row count, taken from the same pass over the data."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return int(seen.get["n"])


def _run(spark: SparkSession, stage: str, sources: Iterable[str], run_date: str, step: Callable[[str], int]) -> DataFrame:
    rows = []
    for source in sources:
        try:
            n_records = step(source)
            rows.append((run_date, stage, source, f"ok ({n_records} records)", n_records, None))
        except Exception as error:  # one source must not stop the others
            rows.append((run_date, stage, source, f"failed: {error}", None, str(error)))
    return spark.createDataFrame(rows, REPORT)


def run_ingest(
    spark: SparkSession, payloads: Mapping[str, Callable[[], DataFrame]], raw_root: str, run_date: str | None = None
) -> DataFrame:
    """Write every source's payloads to the raw zone; returns the run report.

    ``payloads`` maps a source to a function that builds its ``(payload, ...)`` table, so that an error
    in building one source is that source's failure.
    """
    run_date = run_date or default_run_date()

    def step(source: str) -> int:
        raw = envelope(payloads[source](), source)
        return _counted(raw, lambda df: write_raw(df, raw_root, source, run_date))

    return _run(spark, "ingest", payloads, run_date, step)


def run_process(
    spark: SparkSession,
    raw_root: str,
    processed_root: str,
    snapshots: Snapshots | None = None,
    run_date: str | None = None,
    sources: Iterable[str] | None = None,
    form: str = "parquet",
) -> DataFrame:
    """Normalize every source of one run date into the processed zone and the keyed snapshot.

    The zone is written before the snapshot, so a source that fails late leaves its zone partition behind.
    """
    run_date = run_date or default_run_date()

    def step(source: str) -> int:
        raw = read_raw(spark, raw_root, check_source(source), run_date)
        records = normalize_source(raw, source)
        if snapshots is None:
            return _counted(records, lambda df: write_processed(df, processed_root, source, run_date, form))
        work = snapshots.scratch()
        try:
            # Parsed once for both uses.
            records = stored(records, work)
            n_records = _counted(records, lambda df: write_processed(df, processed_root, source, run_date, form))
            snapshots.upsert(source, records)
        finally:
            # Whole texts, so those of one source go before the next comes.
            drop_folder(spark, work)
        return n_records

    return _run(spark, "process", tuple(sources or SOURCES), run_date, step)
