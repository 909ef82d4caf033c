"""The current record per id: hash-bucketed parquet versions of each source, with a manifest of which version holds a bucket."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grantlake.operators.dedup import last_wins, one_per_key
from grantlake.schemas import NORMALIZED, SOURCES
from grantlake.session import drop_folder, estimated_bytes
from grantlake.sources.zones import LINE_ORDER

# Records a bucket is meant for. Buckets are dealt anew, to as many as that takes, when they hold GROWTH times more.
BUCKET_RECORDS, GROWTH = 100_000, 4
# Bytes of a bucket's files, which long records reach first: one task merges a bucket, and its rows are several times larger.
BUCKET_BYTES = 32 * 1024 * 1024
LEAST_BUCKETS, MOST_BUCKETS = 8, 65_536
# What a change of a record is told by: all of it but the time it was fetched.
CONTENT = tuple(name for name in NORMALIZED.fieldNames() if name != "ingested_at")
STORED = T.StructType([*NORMALIZED.fields, T.StructField("content", T.StringType(), False)])
MANIFEST = T.StructType(
    [
        T.StructField("bucket", T.IntegerType(), False),
        T.StructField("n_buckets", T.IntegerType(), False),
        T.StructField("data_version", T.LongType(), False),
        T.StructField("n_records", T.LongType(), False),
        T.StructField("batch", T.StringType(), True),
        T.StructField("version", T.LongType(), True),
    ]
)
# The bucket of a manifest row that says only which batch made a version.
NO_BUCKET = -1


def content_hash() -> Column:
    return F.sha2(F.to_json(F.struct(*CONTENT)), 256)


def changed_since(known: DataFrame | None, records: DataFrame) -> DataFrame:
    """Records that are new, or whose content differs from the known `record_id, content` of the same id."""
    if known is None:
        return records
    hashed = records.withColumn("content", content_hash())
    return hashed.join(known.select("record_id", "content"), ["record_id", "content"], "left_anti").drop("content")


def _buckets_for(n_records: int, n_bytes: int = 0) -> int:
    wanted = max(LEAST_BUCKETS, -(-n_records // BUCKET_RECORDS), -(-n_bytes // BUCKET_BYTES))
    return min(MOST_BUCKETS, 1 << (wanted - 1).bit_length())


class Snapshots:
    """For each source a series of versions under one root.

    A version's manifest names, for every bucket, the version whose folder holds its records, and the batch that made it.
    An upsert reads and rewrites the buckets its ids fall into and no others; a manifest is one file, written last. Nothing
    is changed once written, so readers and restarted tasks see whole files. Old folders are left for the owner to drop.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, source: str) -> str:
        return f"{self.root}/source={source}"

    def _manifests(self, source: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self._folder(source)}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _newest(self, source: str) -> list[Row]:
        """The rows of the newest manifest: at most one a bucket, and the one of its batch."""
        found = self._manifests(source)
        if found is None:
            return []
        version = found.agg(F.max("version")).first()[0]
        return found.where(F.col("version") == version).collect()

    def has_batch(self, source: str, batch: str) -> bool:
        """Whether a version of the source was made from this batch."""
        found = self._manifests(source)
        return found is not None and not found.where((F.col("bucket") == NO_BUCKET) & (F.col("batch") == batch)).isEmpty()

    def _read(self, source: str, buckets: list[Row]) -> DataFrame:
        paths = [f"{self._folder(source)}/data/version={b.data_version}/bucket={b.bucket}" for b in buckets]
        return self.spark.read.schema(STORED).parquet(*paths)

    def _buckets(self, source: str) -> list[Row]:
        return [row for row in self._newest(source) if row.bucket != NO_BUCKET]

    def current(self, source: str) -> DataFrame | None:
        buckets = self._buckets(source)
        return self._read(source, buckets).select(*NORMALIZED.fieldNames()) if buckets else None

    def contents(self, source: str) -> DataFrame | None:
        """`record_id, content`: the hash of every current record. No text is read for it."""
        buckets = self._buckets(source)
        return self._read(source, buckets).select("record_id", "content") if buckets else None

    def all_current(self) -> DataFrame:
        """The current records of every source that has any."""
        found = [current for current in map(self.current, SOURCES) if current is not None]
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], NORMALIZED)

    def scratch(self) -> str:
        """A new folder for what a job computes once and uses twice."""
        return f"{self.root}/_work/{uuid.uuid4().hex}"

    def upsert(self, source: str, records: DataFrame, batch: str | None = None) -> list[int]:
        """Replace or add records of a source by id; of equal ids in `records` the last line wins. Returns the buckets written.

        With a `batch` that a version was already made from nothing is done, so a repeated batch leaves no second version.
        """
        if batch is not None and self.has_batch(source, batch):
            return []
        work = self.scratch()
        try:
            return self._merge(source, records, batch, work)
        finally:
            drop_folder(self.spark, work)

    def _merge(self, source: str, records: DataFrame, batch: str | None, work: str) -> list[int]:
        newest = self._newest(source)
        held = [row for row in newest if row.bucket != NO_BUCKET]
        version = max((row.version for row in newest), default=-1) + 1
        rows = last_wins(None, records.select(*NORMALIZED.fieldNames(), LINE_ORDER), "record_id", LINE_ORDER).drop(LINE_ORDER)
        rows.withColumn("content", content_hash()).write.parquet(work, compression="zstd")
        new = self.spark.read.schema(STORED).parquet(work)
        n_new, n_held = new.count(), sum(row.n_records for row in held)
        # Files are listed for this, not read.
        n_bytes = (estimated_bytes(new) or 0) + ((estimated_bytes(self._read(source, held)) or 0) if held else 0)
        n_buckets = held[0].n_buckets if held else _buckets_for(n_new, n_bytes)
        full = n_held + n_new > GROWTH * BUCKET_RECORDS * n_buckets or n_bytes > GROWTH * BUCKET_BYTES * n_buckets
        whole = bool(held) and full and n_buckets < MOST_BUCKETS
        n_buckets = _buckets_for(n_held + n_new, n_bytes) if whole else n_buckets
        bucket = F.pmod(F.xxhash64("record_id"), F.lit(n_buckets)).cast("int")
        touched = sorted(row.bucket for row in new.select(bucket.alias("bucket")).distinct().collect())
        read = [row for row in held if whole or row.bucket in set(touched)]
        written = []
        if n_new:
            both = new.withColumn("_new", F.lit(1))
            if read:
                both = both.unionByName(self._read(source, read).withColumn("_new", F.lit(0)))
            # One shuffle by bucket serves both the merge by id and the files.
            dealt = both.withColumn("bucket", bucket).repartition(n_buckets if whole else len(touched), "bucket")
            merged = one_per_key(dealt, ["bucket", "record_id"], [F.desc("_new")]).drop("_new")
            target = f"{self._folder(source)}/data/version={version}"
            merged.write.mode("overwrite").partitionBy("bucket").parquet(target, compression="zstd")
            counts = self.spark.read.parquet(target).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()
            written = [(row.bucket, n_buckets, version, row.n, None) for row in sorted(counts)]
        kept = [(row.bucket, n_buckets, row.data_version, row.n_records, None) for row in held if row not in read]
        listed = self.spark.createDataFrame([*kept, *written, (NO_BUCKET, n_buckets, version, 0, batch)], T.StructType(MANIFEST.fields[:-1]))
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self._folder(source)}/manifest/version={version}")
        return [row[0] for row in written]
