"""The approximate vector ranking: recall against the exact one, exact scores, odd vectors, large groups of equal ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grantlake.operators import vector_index as V
from grantlake.operators.retrieve import cosine_topk
from grantlake.registry.queries import REGISTRY


def hits(df):
    return {(r.question_id, r.record_id, r.ord): round(r.score, 9) for r in df.collect()}


def test_probes_cross_the_nearest_planes():
    found = np.array([[[0.1, -2.0, 0.3, 5.0]]])
    codes = V.probed_codes(found, 4)[0, 0].tolist()
    assert codes == [0b1101, 0b1100, 0b1001, 0b1000]
    assert V.probed_codes(found, 1)[0, 0].tolist() == [0b1101]
    every = V.probed_codes(found, 100)[0, 0].tolist()
    assert len(every) == len(set(every)) == 1 + 4 + 6


def test_recall_on_clusters(spark):
    """Many near neighbours and many more buckets than are probed."""
    random = np.random.default_rng(3)
    centres = random.normal(size=(150, 32))
    vectors = np.repeat(centres, 40, axis=0) + 0.35 * random.normal(size=(6000, 32))
    records = spark.createDataFrame([(f"r{i}", i, v.tolist()) for i, v in enumerate(vectors)], "record_id string, ord long, embedding array<double>")
    asked = [(i, (c + 0.2 * random.normal(size=32)).tolist()) for i, c in enumerate(centres[::5])]
    questions = spark.createDataFrame(asked, "question_id long, embedding array<double>")
    index = V.VectorIndex.build(records, n_tables=10, code_vectors=8)
    assert index.n_planes == 10
    found, exact = index.topk(questions, 10, n_probes=8), cosine_topk(questions, records, 10)
    shares = [r.recall for r in V.recall(found, exact).collect()]
    assert len(shares) == 30 and np.mean(shares) >= 0.9
    probes = V._codes(questions, "question_id", 10, 10, 8)
    assert probes.join(index.codes, ["size", "table", "code"]).select("question_id", "row").distinct().count() < 0.15 * 30 * 6000
    right, got = hits(exact), hits(found)
    assert all(got[key] == right[key] for key in got.keys() & right.keys())


def test_odd_vectors(spark):
    rows = [("a", 1, [1.0, 0.0]), ("b", 2, []), ("c", 3, None), ("d", 4, [0.0, 0.0]), ("e", 5, [1.0, 0.0, 0.0]), ("f", 6, [-1.0, 0.0]), ("g", 7, [2.0, 0.1]), ("g", 7, [2.0, 0.1]), ("h", 8, [None, 1.0])]
    records = spark.createDataFrame(rows, "record_id string, ord long, embedding array<double>")
    questions = spark.createDataFrame([(1, [1.0, 0.0]), (2, []), (3, None), (4, [0.0, 0.0])], "question_id long, embedding array<double>")
    found = V.VectorIndex.build(records).topk(questions, 5)
    assert [(r.question_id, r.rank, r.record_id) for r in found.orderBy("rank").collect()] == [(1, 1, "a"), (1, 2, "g"), (1, 3, "g")]
    assert V.VectorIndex.build(records).topk(questions, 0).count() == 0
    assert V.VectorIndex.build(records.limit(0)).topk(questions).count() == 0


def test_equal_vectors_fill_no_bucket(spark):
    same = spark.range(3000).select(F.concat(F.lit("s"), "id").alias("record_id"), F.col("id").alias("ord"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    index = V.VectorIndex.build(same)
    questions = spark.createDataFrame([(1, [1.0, 2.0])], "question_id long, embedding array<double>")
    found = index.topk(questions, 3).orderBy("rank").collect()
    assert [r.record_id for r in found] == ["s0", "s1", "s2"]
    assert index.codes.where("place <= 3").select("row").distinct().count() == 3


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_reports_its_recall(spark, sf):
    rows = REGISTRY["cosine_lsh_topk"](spark, f"/root/testdata/{sf}").collect()
    by_question = {r.question_id: r.recall for r in rows}
    assert len(by_question) == 10 and np.mean(list(by_question.values())) >= 0.9
