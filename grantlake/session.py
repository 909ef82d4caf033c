"""Session settings and the few places where a job needs to know about the cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_BYTES_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(16 * 1024 * 1024)

# Runtime SQL settings the jobs are written for. Applied only by `build_session`;
# a session handed in by the caller is left alone, but for the batch size (see `bound_batches`).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Whole documents travel to Arrow tasks, so bound batches by bytes, not only by rows.
    BATCH_BYTES_KEY: BATCH_BYTES,
}


# The input split the jobs are sized for, and the most parts a shuffle is asked for.
PARTITION_BYTES = 128 * 1024 * 1024
MAX_PARTS = 200_000
# Estimates from here on stand for "unknown".
UNKNOWN_BYTES = 1 << 60


def build_session(app_name: str = "grantlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def bound_batches(df: DataFrame) -> DataFrame:
    """Limit Arrow batches by bytes where the session does not say how large they may get.

    By rows alone, ten thousand whole documents would make one batch. Results do not depend on it.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES_KEY, None) is None:
        conf.set(BATCH_BYTES_KEY, BATCH_BYTES)
    return df


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate, which for file scans is the size on disk; None when it does not know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_BYTES else None


def spread(df: DataFrame) -> DataFrame:
    """Give every core some rows when the input is smaller than the cluster.

    A table that already fills the cores passes through untouched, so this never shuffles at scale.
    """
    size, cores = estimated_bytes(df), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size is not None and size < cores * PARTITION_BYTES else df


def spread_by(df: DataFrame, key: str) -> DataFrame:
    """Shuffle rows by a key that what follows needs together, in parts of about one input split.

    The number is given so that adaptive execution does not merge parts that look small here but
    grow many times when the rows are taken apart.
    """
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = estimated_bytes(df)
    if size is not None:
        n_parts = max(n_parts, min(size // PARTITION_BYTES, MAX_PARTS))
    return df.repartition(n_parts, key)


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: `spark.checkpoint.dir`, or one of our own on a single machine (tests)."""
    folder = spark.conf.get(CHECKPOINT_KEY, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="grantlake-"))
    return context.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again, so that what follows does not compute them twice."""
    path = path or new_folder(df.sparkSession, "table")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that the job itself made and does not read any more, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
