"""Pick up new raw files as they arrive and keep the snapshot current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grantlake.operators.dedup import last_wins
from grantlake.operators.normalize import normalize_source
from grantlake.plans.snapshots import Snapshots, changed_since, content_hash
from grantlake.schemas import REPORT, SOURCES
from grantlake.session import stored
from grantlake.sources.zones import LINE_ORDER, parse_raw_lines, with_line_order


def line_stream(spark: SparkSession, raw_root: str, max_files: int | None = None) -> DataFrame:
    """Raw lines of every source as a stream over ``source=*/run_date=*`` folders, with where they come from."""
    reader = spark.readStream.schema("value string, source string, run_date string").format("text")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(raw_root).select("value", "source", "run_date", "_metadata")


def changed(current: DataFrame | None, records: DataFrame) -> DataFrame:
    """Records that are new, or whose content differs from the current record of the same id."""
    return changed_since(None if current is None else current.withColumn("content", content_hash()), records)


def run_incremental(
    spark: SparkSession,
    raw_root: str,
    snapshots: Snapshots,
    checkpoint: str,
    on_change: Callable[[str, DataFrame], None] | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Process everything that arrived since the last run, then stop.

    ``on_change(source, records)`` receives the new and changed records of each batch before the
    snapshot takes them, for example to embed them. A batch repeated after a failure leaves the same snapshot.
    Sources fail alone: the lines of one that fails are set aside under ``_quarantine`` and the others go on. What became of
    each source is told by `run_reports`.
    """

    def step(source: str, lines: DataFrame, batch: str) -> int:
        records = stored(normalize_source(parse_raw_lines(lines), source), snapshots.scratch())
        if on_change is not None and not snapshots.has_batch(source, batch):
            latest = last_wins(None, records, "record_id", LINE_ORDER)
            on_change(source, changed_since(snapshots.contents(source), latest))
        snapshots.upsert(source, records, batch)
        return records.count()

    def apply(batch: DataFrame, batch_id: int) -> None:
        ordered = with_line_order(batch).drop("_metadata")
        unknown = ordered.where(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False))).select("source").first()
        if unknown is not None:
            raise ValueError(f"raw lines of a source without a mapping: {unknown['source']!r}")
        name, rows = f"{checkpoint}#{batch_id}", []
        for source in SOURCES:
            lines = ordered.where(F.col("source") == source).drop("source")
            if lines.isEmpty():
                continue
            try:
                n_records = step(source, lines, name)
                rows.append((str(batch_id), "incremental", source, f"ok ({n_records} records)", n_records, None))
            except Exception as error:  # one source must not stop the others
                lines.select("value").write.mode("overwrite").text(f"{snapshots.root}/_quarantine/source={source}/batch={batch_id}")
                rows.append((str(batch_id), "incremental", source, f"failed: {error}", None, str(error)))
        report = batch.sparkSession.createDataFrame(rows, REPORT).coalesce(1)
        report.write.mode("overwrite").parquet(f"{snapshots.root}/_reports/batch={batch_id}")

    return (
        line_stream(spark, raw_root, max_files)
        .writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_reports(snapshots: Snapshots) -> DataFrame:
    """What became of each source in each batch; the batch stands in place of a run date."""
    return snapshots.spark.read.schema(REPORT).parquet(f"{snapshots.root}/_reports/*")
