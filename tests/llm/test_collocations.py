"""Collocations against brute force: chunks of the parse, counts of phrases, scores and coverage, the SQL, awkward rows."""

import collections
import re
import string

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from grantlake.llm import collocations
from grantlake.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def pieces(text):
    found = re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))
    return [words for words in (re.findall(r"[^\x20\x09]+", p) for p in found) if words]


def phrase_counts(rows):
    counts = collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            counts[lang, ""] += len(words)
            for n in range(1, 5):
                counts.update((lang, " ".join(words[i : i + n])) for i in range(len(words) - n + 1))
    return counts


def expected(rows, min_count, top):
    counts = phrase_counts(rows)
    found = collections.defaultdict(list)
    candidates = {(lang, p): a for (lang, p), a in counts.items() if a >= min_count and " " in p}
    for (lang, p), a in candidates.items():
        w = p.split(" ")
        if any(l2 == lang and len(q) > len(p) and f" {p} " in f" {q} " and 100 * b >= 80 * a for (l2, q), b in candidates.items()):
            continue
        cuts = [(counts[lang, " ".join(w[:k])], counts[lang, " ".join(w[k:])]) for k in range(1, len(w))]
        score, k = min((2000000 * a // (x + y), k) for k, (x, y) in enumerate(cuts))
        found[lang].append((-score, -a, p.encode(), p, a, *cuts[k], counts[lang, ""], score))
    return sorted((lang, i + 1, *r[3:]) for lang, rs in found.items() for i, r in enumerate(sorted(rs)[:top]))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_chunks_hold_every_phrase_once():
    random = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)] + ["É", "x" * 300, "a\x1cb"]
    marks = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\r\n"]
    texts = ["".join(w + m for w, m in zip(random.choice(words, n), random.choice(marks, n))) for n in (0, 1, 2, 3, 4, 50, 4000)]
    texts += ["", " . ", "same " * 300, "\tX Y", "one"]
    counts = collections.Counter()
    for trigger in (1, 2, 16, 10**9):
        found, alone = collocations.chunks([t.encode() for t in texts], trigger)
        counts = collections.Counter()
        for chunk, own in zip(found, alone):
            w = chunk.decode().split(" ")
            assert len(w) in (own, own + collocations.WINDOW)
            counts[""] += int(own)
            for n in range(1, 5):
                counts.update(" ".join(w[i : i + n]) for i in range(min(own, len(w) - n + 1)))
        assert counts == collections.Counter({p: f for (_, p), f in phrase_counts([("x", t) for t in texts]).items()})


def test_equal_passages_give_equal_chunks():
    random = np.random.default_rng(2)
    words = [f"w{i}" for i in range(5000)]
    passage = " ".join(random.choice(words, 2000))
    texts = [f"{' '.join(random.choice(words, 50 + k))} {passage} {' '.join(random.choice(words, 50))}".encode() for k in range(20)]
    found, _ = collocations.chunks(texts)
    assert len(set(found)) < 0.2 * len(found)


def test_screen_has_the_hashes_of_the_tasks(spark):
    pairs = [("en", "a b"), ("é", "ü 𝔘"), ("", "x y"), ("und", "l" * 300 + " er")]
    table = collocations.screen(spark.createDataFrame(pairs, "lang string, phrase string"))
    for lang, phrase in pairs:
        first, second = (collocations.word_marks(lang, [w.encode()]) for w in phrase.split(" "))
        bits = collocations.pair_bits(first, second, 64 * len(table))[:, 0]
        assert all(int(table[int(b) >> 6]) >> (int(b) & 63) & 1 for b in bits)
    assert sum(int(v).bit_count() for v in table) <= 2 * len(pairs)


ROWS = [
    ("en", "The quick Brown fox. the quick brown fox, jumps over the quick brown dog! " * 9),
    ("en", "new york city is not new york state; new york, new york " * 7),
    ("en", "new york city is not new york state; new york, new york " * 7),
    (None, "so so so so so so so so\nso so"), (None, "a.b a b\ta b  a b"), (None, None), ("", "a b. a b. a b. a b."), ("de", ""),
    ("xx", "É é É é. " * 5 + "\x1c\x1c x " * 6),
]


@pytest.mark.parametrize("min_count, top", [(3, 2000), (5, 4), (1, 3)])
def test_collocations(spark, min_count, top):
    docs = spark.createDataFrame(ROWS, "lang string, text string").withColumns({c: F.lit("x") for c in ("phrase", "n", "f", "chunk", "size")})
    assert rows_of(collocations.collocations(docs.repartition(3), min_count, top)) == expected(ROWS, min_count, top)


def test_nothing_is_lost_when_the_screen_is_full(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MAX_BITS", 64)
    docs = spark.createDataFrame(ROWS, "lang string, text string")
    assert rows_of(collocations.collocations(docs, 3)) == expected(ROWS, 3, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10**15 + 1
    rows = [("en", 0, "", 9 * 10**17), ("en", 1, "a", big + 5), ("en", 1, "b", big + 2), ("en", 2, "a b", big)]
    found = collocations.best_cuts(spark.createDataFrame(rows, "lang string, size int, phrase string, f long")).first()
    assert found.score == 2000000 * big // (2 * big + 7)


def test_empty(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(spark.createDataFrame([("en", " .,")], "lang string, text string")).collect() == []


def test_query_is_its_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = QUERIES["op13_collocations"](spark, sf_dir)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(found) == sorted(db.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({ORACLES['op13_collocations']})").fetchall())
