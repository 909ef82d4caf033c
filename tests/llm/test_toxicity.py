"""Toxicity: features and swaps by hand, the fit against a plain one, false positives on neutral mentions, held-out accuracy."""

import zlib

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from grantlake.llm import toxicity
from grantlake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, score string, held_out int"
GROUPS = (("muslims", "christians", "jews", "people"), ("gay", "straight", "human"))


def test_words_features_and_swaps():
    assert toxicity.distinct_words("Thé the_THE 7x%%% x's") == {"thé", "the", "x", "s"}
    assert toxicity.word_features("moron") == ["=moron", "moro", "moron"]
    swap = toxicity.swaps(GROUPS)
    assert swap["jews"] == ["people", "muslims", "christians"]
    found = toxicity.swapped_words("The jews came. Nobody saw gay muslims! End", swap)
    assert found == [
        {"the", "people", "came", "nobody", "saw", "straight", "christians", "end"},
        {"the", "muslims", "came", "nobody", "saw", "human", "jews", "end"},
        {"the", "christians", "came", "nobody", "saw", "straight", "people", "end"},
    ]
    assert toxicity.swapped_words("nothing here.", swap) == [] == toxicity.swapped_words("", swap)
    every = toxicity.swaps()
    assert all(other in every or other.isalpha() for others in every.values() for other in others)


def test_fit_is_the_minimum_of_its_loss():
    random = np.random.default_rng(1)
    x = random.poisson(0.4, (300, 4)).astype(float)
    y = (x[:, 0] + random.normal(size=300) > 1).astype(float)
    moves = np.array([[0.0, 1, -1, 0], [0, 0, 1, 0]])
    w, b = toxicity.fit_logistic(x, y, moves, 0.5, 3.0)

    def loss(w, b):
        z = x @ w + b
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.25 * w @ w + 1.5 * ((moves @ w) ** 2).sum()

    for i in range(5):
        for step in (-1e-3, 1e-3):
            moved = w + step * (np.arange(4) == i), b + step * (i == 4)
            assert loss(*moved) >= loss(w, b)
    for labels in (np.zeros(3), np.ones(3)):
        assert not toxicity.fit_logistic(np.ones((3, 2)), labels, np.empty((0, 2)))[0].any()


def fixture(spark):
    """Insults stand mostly beside one group, so that a plain model takes the group for an insult."""
    random = np.random.default_rng(3)
    filler = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(200)]
    rows = []
    for i in range(1200):
        words = list(random.choice(filler, 30))
        toxic = i % 4 == 0
        if toxic:
            # Half of the toxic texts have no insult that is frequent enough to be learnt.
            words[3] = "moron" if i % 8 else f"rare{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}"
            words[9] = "muslims" if i % 3 else "wellknown"
        elif i % 4 == 1 and i % 20 == 1:
            words[9] = "christians"
        rows.append((i, " ".join(words[:15]) + ". " + " ".join(words[15:]), int(toxic)))
    neutral = [(10_000 + i, f"The {g} met {' '.join(random.choice(filler, 12))}.", 0) for i, g in enumerate(GROUPS[0] * 10)]
    return rows, neutral


def test_swaps_reduce_false_positives_on_neutral_mentions(spark):
    rows, neutral = fixture(spark)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    texts = [t for _, t, _ in neutral]
    plain = toxicity.fit_toxicity(docs, labels, swap_weight=0.0)
    held = toxicity.fit_toxicity(docs, labels)
    muslims = [i for i, t in enumerate(texts) if "muslims" in t]
    assert (plain.scores(texts)[muslims] >= 0.5).mean() >= 0.9
    assert (held.scores(texts) >= 0.5).sum() == 0
    assert np.ptp([held.scores([t.replace("muslims", g)])[0] for t in texts[:1] for g in GROUPS[0]]) < 0.05
    insults = [t for _, t, _ in rows if "moron" in t.split()]
    assert (held.scores(insults) >= 0.5).mean() >= 0.95


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, "you moron", "a", 1), (1, "you moron", "a", 1), (2, None, None, None), (3, "", "", 0), (None, "plain", "x", 1),
            (4, "word " * 50_000 + "moron", "y", 2), (5, "İ ǅ %%%", "z", 3)]
    return spark.createDataFrame(rows, SCHEMA)


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (4, 1), (5, 0), (6, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd, labels)).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert len({r.score for r in found if r.doc_id == 1}) == 1
    assert len({r.score for r in found if r.doc_id in (2, 3)}) == 1
    none = toxicity.fit_toxicity(odd, labels.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(odd, none).collect()} == {0}
    assert toxicity.score_toxicity(odd.limit(0), none).count() == 0


def test_held_out_labels_are_never_read(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit_toxicity(docs, x) for x in (labels, turned))
    assert a.features == b.features and (a.weights == b.weights).all() and a.bias == b.bias


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = QUERIES["op11_toxicity"](spark, sf_dir)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    toxic, other = ([r.score for r in rows if r.toxic == y] for y in (1, 0))
    area = np.mean([(t > np.array(other)).mean() + 0.5 * (t == np.array(other)).mean() for t in toxic])
    assert area >= 0.95
    assert np.mean([t >= 0.5 for t in toxic]) >= 0.85 and np.mean([o >= 0.5 for o in other]) <= 0.01
