"""The raw and processed zones: files partitioned by source and run date."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantlake.functions.text import WHITESPACE
from grantlake.operators.normalize import record_json
from grantlake.schemas import NORMALIZED, RAW_DDL

# Orders the raw lines of a source, so that of two equal ids the later line wins.
LINE_ORDER = "line_order"
TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def default_run_date() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d")


def partition_path(root: str, source: str, run_date: str) -> str:
    return f"{root.rstrip('/')}/source={source}/run_date={run_date}"


def envelope(payloads: DataFrame, source: str | Column, fetched_at: Column | None = None) -> DataFrame:
    """Wrap payloads (VARIANT or JSON text) as raw rows stamped with the fetch time."""
    payload = F.col("payload")
    if dict(payloads.dtypes)["payload"] == "string":
        payload = F.parse_json(payload)
    if fetched_at is None:
        fetched_at = F.date_format(F.current_timestamp(), TIMESTAMP_FORMAT)
    source = F.lit(source) if isinstance(source, str) else source
    extra = [c for c in payloads.columns if c not in ("source", "payload", "fetched_at")]
    return payloads.select(source.alias("source"), payload.alias("payload"), fetched_at.alias("fetched_at"), *extra)


def raw_lines(raw: DataFrame) -> DataFrame:
    """Raw rows as JSON lines."""
    row = F.struct("source", "payload", "fetched_at")
    return raw.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))


def parse_raw_lines(lines: DataFrame) -> DataFrame:
    """JSON lines (column ``value``) to raw rows. Blank lines are skipped, a malformed one fails the job."""
    full = lines.where(F.length(F.trim(F.col("value"), F.lit(WHITESPACE))) > 0)
    extra = [c for c in lines.columns if c != "value"]
    parsed = full.select(F.from_json("value", RAW_DDL, {"mode": "FAILFAST"}).alias("raw"), *extra)
    return parsed.select("raw.source", "raw.payload", "raw.fetched_at", *extra)


def with_line_order(lines: DataFrame) -> DataFrame:
    """Add where each line stands: by file, part of the file, and row within that part.

    Paths hold the run date, so later dates of a source sort after earlier ones. Stable under retries.
    """
    path = F.col("_metadata.file_path")
    place = F.struct(
        F.regexp_extract(path, r"^(.*/)", 1).alias("folder"),
        # Part numbers are padded to five digits only, so they do not sort as text.
        F.regexp_extract(path, r"/part-(\d{1,18})[^/]*$", 1).try_cast("long").alias("part"),
        path.alias("file_path"),
        "_metadata.file_block_start",
        F.monotonically_increasing_id().alias("row"),
    )
    return lines.select("*", place.alias(LINE_ORDER))


def read_raw(spark: SparkSession, root: str, source: str, run_date: str) -> DataFrame:
    """Raw rows of one source and date in line order; a partition that was never written is an error."""
    return parse_raw_lines(with_line_order(spark.read.text(partition_path(root, source, run_date))))


def write_raw(raw: DataFrame, root: str, source: str, run_date: str) -> None:
    """Replace one (source, date) partition, also by nothing when ``raw`` is empty. Files are packed: each was one task's and is read by one."""
    raw_lines(raw).write.mode("overwrite").text(partition_path(root, source, run_date), compression="gzip")


def write_processed(records: DataFrame, root: str, source: str, run_date: str, form: str = "parquet") -> None:
    """Replace one (source, date) partition of normalized records, as parquet or as JSON lines."""
    target = partition_path(root, source, run_date)
    if form == "json":
        record_json(records).write.mode("overwrite").text(target)
    else:
        records.select(*NORMALIZED.fieldNames()).drop("source").write.mode("overwrite").parquet(target, compression="zstd")


def read_processed(spark: SparkSession, root: str) -> DataFrame:
    """All processed records written as parquet; source and run_date come back as partition columns."""
    stored = T.StructType([f for f in NORMALIZED.fields if f.name != "source"])
    partitions = [T.StructField("source", T.StringType()), T.StructField("run_date", T.StringType())]
    found = spark.read.schema(T.StructType(stored.fields + partitions)).parquet(root)
    return found.select(*NORMALIZED.fieldNames(), "run_date")
