"""Helpers the operators share: tables, cut lineage, global running totals, connected components, Arrow columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
CHECKPOINT_KEY = "spark.checkpoint.dir"
# Tables of at most so many numbers or narrow rows, counted first, may be broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that lost executors do not undo them."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def filed(df: DataFrame, name: str) -> DataFrame:
    """As `cut`, for wide rows: written as compressed Parquet to a new folder of the shared one, and read from there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """`df`, marked for broadcast only if its counted rows stay below the bound."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """Add, to each row, sums over all rows before it in a global order.

    Rows are range-partitioned and kept; sums of whole partitions (one row each) are added up and the rest is a
    window inside each partition, so no task sees more than its range. Rows equal in `order` stay in one partition.
    """
    names = list(totals)
    inner = {f"_{name}": value.cast("long") for name, value in totals.items()}
    ranged = cut(df.withColumns(inner).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(*[F.sum(f"_{name}").alias(f"_{name}") for name in names])
    offsets = parts.select("_part", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_offset_{n}") for n in names])
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.join(F.broadcast(offsets), "_part").withColumns(
        {n: F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)) + F.col(f"_offset_{n}") for n in names}
    )
    return summed.drop("_part", *inner, *[f"_offset_{n}" for n in names])


def connected_components(edges: DataFrame) -> DataFrame:
    """`id, component` (smallest id reachable) for every id of the edges `a, b` (integers).

    Alternates large-star and small-star steps until the edges are stars. Every step is a map-side combined minimum
    and a join back, which adaptive execution splits where one id has very many edges.
    """
    stars = cut(_downward(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))))
    mark = _fingerprint(stars)
    while True:
        stars = cut(_small_star(_large_star(stars)))
        found = _fingerprint(stars)
        if found == mark:
            break
        mark = found
    roots = stars.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return stars.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots).distinct()


def _downward(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller id."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return pairs.where("a != b").distinct()


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("a").agg(F.min("b").alias("m"))
    linked = stars.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def byte_values(column: pa.Array) -> list[bytes | None]:
    """The values of a string or binary Arrow column as bytes."""
    return column.cast(pa.large_binary()).to_pylist()


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit integers scattered by a fixed bijection (constants of the splitmix64 finaliser)."""
    z = values + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def sorted_set(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; a sort is several times faster here than the hash table of numpy's own."""
    values = np.sort(values)
    return values[np.concatenate([np.ones(min(len(values), 1), bool), values[1:] != values[:-1]])]


def document_key() -> dict[str, Column]:
    """Two plain columns that tell documents apart by doc_id (null is a value) and text (null is empty)."""
    no_id = F.col("doc_id").isNull()
    return {
        "key_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
        "key_text": F.xxhash64(F.coalesce("text", F.lit("")), no_id),
    }
