"""Approximate vector ranking: hash tables over vectors, multi-probe look-up, exact scores of what is found.

A vector's code in a table says on which side of some random planes it lies. Similar vectors often share a code, and where they
do not they mostly differ in a plane that one of them is near to, so a question also probes the codes across its nearest planes.
What the tables give is scored exactly; only a record that shares no probed code with a question can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grantlake.functions.vectors import cosine_similarity
from grantlake.operators.rank import DEFAULT_TOP_K, check_k, top_per_question, with_ord
from grantlake.session import bound_batches, new_folder, stored

TABLES, PROBES = 24, 24
# Vectors a code should have on average; from it and their number follow the planes of a table, at most MAX_PLANES.
CODE_VECTORS, MAX_PLANES = 64, 24
# Planes a probe may cross at once, and the nearest planes they are taken from.
MOST_CROSSED, NEAREST = 2, 8
SEED = 20_261


def planes(size: int, n_tables: int, n_planes: int) -> np.ndarray:
    """The normals of all tables' planes for vectors of one size, as columns."""
    return np.random.default_rng([SEED, size, n_planes]).normal(size=(size, n_tables * n_planes))


def projections(vectors: pa.ListArray, rows: np.ndarray, size: int, n_tables: int, n_planes: int) -> np.ndarray:
    flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return (flat.reshape(len(rows), size) @ planes(size, n_tables, n_planes)).reshape(len(rows), n_tables, n_planes)


def probed_codes(found: np.ndarray, n_probes: int) -> np.ndarray:
    """The codes to look up in each table, `found` being (rows, tables, planes) projections: the own code first, then those
    across the planes that are nearest together."""
    n_planes = found.shape[2]
    bits = 1 << np.arange(n_planes, dtype=np.int64)
    own = ((found > 0) * bits).sum(axis=2)
    near = np.argsort(np.abs(found), axis=2, kind="stable")[:, :, : min(NEAREST, n_planes)]
    margin = np.take_along_axis(np.abs(found), near, axis=2)
    sets = [c for n in range(1, MOST_CROSSED + 1) for c in combinations(range(near.shape[2]), n)]
    if not sets or n_probes <= 1:
        return own[:, :, None]
    costs = np.stack([(margin[:, :, list(c)] ** 2).sum(axis=2) for c in sets], axis=2)
    flips = np.stack([bits[near[:, :, list(c)]].sum(axis=2) for c in sets], axis=2)
    best = np.argsort(costs, axis=2, kind="stable")[:, :, : n_probes - 1]
    return np.concatenate([own[:, :, None], own[:, :, None] ^ np.take_along_axis(flips, best, axis=2)], axis=2)


def _codes(rows: DataFrame, key: str, n_tables: int, n_planes: int, n_probes: int) -> DataFrame:
    """`key, size, table, code` of every vector that is neither empty nor zero nor holds a null."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, keys = batch.column("embedding"), batch.column(key)
            sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]):
                same = np.flatnonzero(sizes == size)
                for at in (same[i : i + 1024] for i in range(0, len(same), 1024)):
                    codes = probed_codes(projections(vectors, at, size, n_tables, n_planes), n_probes)
                    n, _, each = codes.shape
                    columns = [
                        keys.take(pa.array(np.repeat(at, n_tables * each))),
                        pa.array(np.full(codes.size, size), pa.int32()),
                        pa.array(np.tile(np.repeat(np.arange(n_tables), each), n), pa.int32()),
                        pa.array(codes.ravel()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, [key, "size", "table", "code"])

    usable = rows.where(F.size("embedding") > 0).where(F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull()))
    schema = usable.select(key).schema.add("size", "integer").add("table", "integer").add("code", "long")
    return bound_batches(usable.select(key, F.col("embedding").cast("array<double>").alias("embedding"))).mapInArrow(code, schema)


class VectorIndex:
    """The tables of an index in one folder: `vectors` by number, and `codes`. They are never changed once written."""

    def __init__(self, spark: SparkSession, folder: str, n_tables: int, n_planes: int) -> None:
        self.vectors, self.codes = spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/codes")
        self.n_tables, self.n_planes = n_tables, n_planes

    @classmethod
    def build(cls, records: DataFrame, folder: str | None = None, n_tables: int = TABLES, code_vectors: int = CODE_VECTORS) -> VectorIndex:
        """Index `records(record_id, [ord,] embedding)`.

        Equal vectors have equal scores, so each knows its place among its equals: no ranking of k needs more than k of them,
        and a vector that a third of all records share fills no bucket.
        """
        spark = records.sparkSession
        folder = folder or new_folder(spark, "vectors")
        rows = with_ord(records).select("record_id", F.col("ord").cast("long").alias("ord"), F.col("embedding").cast("array<double>").alias("embedding"))
        vectors = stored(rows.withColumn("row", F.monotonically_increasing_id()), f"{folder}/vectors")
        n_planes = int(np.clip(np.ceil(np.log2(max(vectors.count() / code_vectors, 2))), 1, MAX_PLANES))
        of_equal = Window.partitionBy(F.xxhash64("embedding"), F.hash("embedding")).orderBy("ord", "record_id", "row")
        places = vectors.select("row", F.row_number().over(of_equal).alias("place"))
        stored(_codes(vectors, "row", n_tables, n_planes, 1).join(places, "row"), f"{folder}/codes")
        return cls(spark, folder, n_tables, n_planes)

    def topk(self, questions: DataFrame, k: int = DEFAULT_TOP_K, n_probes: int = PROBES) -> DataFrame:
        """Hits as of `cosine_topk` for `questions(question_id, embedding)`, with exact scores; some may be missed."""
        check_k(k)
        asked = questions.select("question_id", F.col("embedding").cast("array<double>").alias("asked"))
        probes = _codes(asked.withColumnRenamed("asked", "embedding"), "question_id", self.n_tables, self.n_planes, n_probes)
        near = probes.join(self.codes.where(F.col("place") <= k), ["size", "table", "code"]).select("question_id", "row").distinct()
        pairs = near.join(self.vectors, "row").join(asked, "question_id")
        scored = pairs.select("question_id", "record_id", "ord", cosine_similarity(F.col("embedding"), F.col("asked")).alias("score"))
        return top_per_question(scored.where("score > 0"), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """`question_id, recall`: the share of each question's exact hits that were found. Hits are told by their scores, so that
    one of several equal vectors stands for another."""
    by_score = exact.groupBy("question_id", F.round("score", 9).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    got = found.groupBy("question_id", F.round("score", 9).alias("s")).agg(F.count(F.lit(1)).alias("m"))
    both = by_score.join(got, ["question_id", "s"], "left")
    return both.groupBy("question_id").agg((F.sum(F.least("n", F.coalesce("m", F.lit(0)))) / F.sum("n")).alias("recall"))
