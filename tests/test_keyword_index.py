"""The stored word index against the scan ranking and a plain one, and what it prunes."""

import random

import pytest
from conftest import SF_DIR
from test_retrieve import WORDS, expected, word_score

from grantlake.operators import keyword_index as K
from grantlake.operators.retrieve import keyword_topk
from grantlake.registry import inputs
from grantlake.registry.queries import REGISTRY


def hits(df):
    return sorted(map(tuple, df.select("question_id", "rank", "record_id", "ord", "score").collect()))


@pytest.fixture(scope="module")
def tables(spark):
    random.seed(4)
    texts = [" ".join(random.choices(WORDS, k=random.choice((0, 1, 3, 8, 40)))) for _ in range(300)]
    texts += ["the the the the tax", None, "", "Grant, GRANT!"]
    records = [(f"r{i % 290}", i % 7, t) for i, t in enumerate(texts)]
    questions = [(i, " ".join(random.choices(WORDS + ["zzz"], k=i % 6))) for i in range(40)] + [(99, None)]
    return (
        spark.createDataFrame(questions, "question_id long, question string"),
        spark.createDataFrame(records, "record_id string, ord long, text string").repartition(3),
    )


@pytest.mark.parametrize("k, block", [(1, 16), (5, 16), (5, 1000), (40, 4), (0, 16)])
def test_index_ranks_as_the_scan(spark, tables, k, block):
    questions, records = tables
    index = K.KeywordIndex.build(records, block_records=block)
    assert hits(index.topk(questions, k)) == hits(keyword_topk(questions, records, k))


def test_index_of_documents_is_the_scan(spark):
    questions = inputs.user_questions(spark, SF_DIR)
    assert hits(REGISTRY["keyword_index_topk"](spark, SF_DIR)) == hits(REGISTRY["keyword_retrieve_topk"](spark, SF_DIR))
    assert questions.count() > 0


def test_blocks_are_pruned(spark):
    """One long record holds a word often; blocks of short records cannot reach it and are not read."""
    rows = [(f"r{i}", i, "tax " * (40 if i < 5 else 1) + f"w{i}") for i in range(400)]
    records = spark.createDataFrame(rows, "record_id string, ord long, text string")
    questions = spark.createDataFrame([(1, "tax"), (2, "tax w300")], "question_id long, question string")
    index = K.KeywordIndex.build(records, block_records=8)
    weights = index._weights(K.term_frequencies(questions, "question_id", "question"), 5)
    assert {(r.question_id, r.term): r.opens for r in weights.collect()} == {(1, "tax"): True, (2, "tax"): True, (2, "w300"): False}
    assert index._bounds(weights).count() <= 4 < index.postings.where("term = 'tax'").count()
    assert hits(index.topk(questions)) == hits(keyword_topk(questions, records))


def test_ranking_ships_no_questions(spark, tables):
    questions, records = tables
    plan = K.KeywordIndex.build(records).topk(questions)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_candidates_are_bounded_by_groups_of_splits(spark, tables):
    questions, records = tables
    plan = keyword_topk(questions, records.repartition(500))._jdf.queryExecution().toString()
    assert f"Coalesce {4 * spark.sparkContext.defaultParallelism}" in plan
    assert word_score("tax", "tax tax") == 2.0 and expected is not None


def test_questions_meet_parts_not_blocks(spark):
    """Where nothing can be pruned, a question still meets a fixed number of parts, however many blocks there are."""
    records = spark.createDataFrame([(f"r{i % 390}", i % 7, "tax relief") for i in range(400)], "record_id string, ord long, text string")
    questions = spark.createDataFrame([(1, "tax"), (2, "tax relief")], "question_id long, question string")
    index = K.KeywordIndex.build(records, block_records=1)
    weights = index._weights(K.term_frequencies(questions, "question_id", "question"), 5)
    assert index.postings.where("term = 'tax'").count() == 400
    assert index._bounds(weights).count() <= 2 * 48
    assert hits(index.topk(questions)) == hits(keyword_topk(questions, records))


def test_groups_of_questions_rank_alike(tables, monkeypatch):
    questions, records = tables
    monkeypatch.setattr(K, "MAX_ASKED_TERMS", 20)
    monkeypatch.setattr(K, "TERM_CELLS", 4)
    assert hits(K.keyword_index_topk(questions, records)) == hits(keyword_topk(questions, records))


def test_ties_with_null_keys_keep_their_order(spark):
    rows = [(None, 1, "tax"), ("", 1, "tax"), ("b", None, "tax"), ("a", None, "tax"), ("c", 0, "tax"), ("d", 2, "tax tax")]
    records = spark.createDataFrame(rows, "record_id string, ord long, text string")
    questions = spark.createDataFrame([(1, "tax"), (None, "tax")], "question_id long, question string")
    found = K.keyword_index_topk(questions, records).orderBy("rank").select("question_id", "record_id", "ord").collect()
    assert [tuple(r) for r in found] == [(1, "d", 2), (1, "a", None), (1, "b", None), (1, "c", 0), (1, None, 1)]


def test_negative_k(tables):
    with pytest.raises(ValueError):
        K.keyword_index_topk(*tables, k=-1)
