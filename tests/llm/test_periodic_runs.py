"""Runs against brute force: extensions of the grammar, runs of random and periodic sequences, and the whole smallest table."""

import collections
import hashlib
import re
import zlib

import numpy as np
from conftest import SF_DIR

from grantlake.llm import periodic_runs
from grantlake.llm.queries import QUERIES
from grantlake.llm.recompression import Grammar


def smallest_period(x):
    back = [0] * len(x)
    for i in range(1, len(x)):
        k = back[i - 1]
        while k and x[i] != x[k]:
            k = back[k - 1]
        back[i] = k + (x[i] == x[k])
    return len(x) - back[-1]


def brute_runs(x):
    """Maximal stretches of every period that could be a run's, kept where the period is their smallest."""
    found = set()
    for q in range(1, len(x) // 4 + 1):
        equal = [x[i] == x[i + q] for i in range(len(x) - q)] + [False]
        start = None
        for i, e in enumerate(equal):
            if e and start is None:
                start = i
            elif not e and start is not None:
                length = i - start + q
                if length >= max(6, 4 * q) and smallest_period(x[start : start + length]) == q:
                    found.add((start, length, q))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences(random):
    """Random and periodic sequences, Fibonacci words, blocks of one letter, and mixes of them."""
    for _ in range(60):
        yield random.integers(0, random.integers(1, 4), random.integers(0, 60)).tolist()
    for _ in range(60):
        unit = random.integers(0, 3, random.integers(1, 12)).tolist()
        x = random.integers(0, 3, random.integers(0, 9)).tolist() + (unit * 12)[: random.integers(1, 12 * len(unit) + 1)]
        if random.integers(2) and x:
            x[random.integers(len(x))] = 5
        yield x + random.integers(0, 3, random.integers(0, 9)).tolist()
    a, b = [0], [0, 1]
    for _ in range(9):
        a, b = b, b + a
        yield b
    yield [7] * 500
    yield ([1] * 9 + [2]) * 30 + [1] * 20
    yield ([0, 1] * 7 + [2]) * 9


def test_extensions():
    random = np.random.default_rng(2)
    parts = [x for x in sequences(random) if x]
    y, ends = [], []
    for k, x in enumerate(parts):
        y += [1000 + k, *x]
        ends += [True] + [False] * len(x)
    y, ends = np.array([*y, 5000]), np.array([*ends, True])
    grammar = Grammar(y, ends)
    assert len(grammar.levels[-1].symbols) <= 6 * len(parts)
    starts = np.flatnonzero(ends)
    i, j = [], []
    for a, b in zip(starts, starts[1:]):
        pairs = np.sort(random.integers(a + 1, b, (40, 2)), axis=1)
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        i += pairs[:, 0].tolist()
        j += pairs[:, 1].tolist()
    # Places in different sequences, too: no separator repeats, so these end as well.
    inner = np.flatnonzero(~ends)
    other = np.sort(random.choice(inner, (500, 2)), axis=1)
    other = other[other[:, 0] < other[:, 1]]
    i, j = np.array(i + other[:, 0].tolist()), np.array(j + other[:, 1].tolist())
    found = grammar.extensions(i, j)
    for a, b, n in zip(i, j, found):
        assert (y[a : a + n] == y[b : b + n]).all() and y[a + n] != y[b + n]


def test_runs():
    random = np.random.default_rng(4)
    parts = list(sequences(random))
    x = np.array([v for p in parts for v in p])
    found = periodic_runs.find_runs(x, np.array([len(p) for p in parts]))
    expected = [brute_runs(p) for p in parts]
    assert [list(map(tuple, r.tolist())) for r in found] == expected
    assert sum(map(len, expected)) > 60
    for p, one in zip(parts, expected):
        alone = periodic_runs.find_runs(np.array(p, np.int64), np.array([len(p)]))
        assert list(map(tuple, alone[0].tolist())) == one


def test_grid_is_whole_in_small_steps(monkeypatch):
    random = np.random.default_rng(5)
    parts = list(sequences(random))
    x, lengths = np.array([v for p in parts for v in p]), np.array([len(p) for p in parts])
    monkeypatch.setattr(periodic_runs, "GRID_PLACES", 7)
    assert [list(map(tuple, r.tolist())) for r in periodic_runs.find_runs(x, lengths)] == [brute_runs(p) for p in parts]


def test_long_texts():
    random = np.random.default_rng(6)
    unit = [b"w%d" % i for i in random.integers(0, 10**6, 20_001)]
    text = b" ".join([b"start", *unit * 5, b"end"] + [b"same"] * 50_000)
    ((runs, collapsed),) = periodic_runs.text_runs([text])
    assert runs.tolist() == [[1, 100_005, 20_001], [100_007, 50_000, 1]]
    assert collapsed == b" ".join([b"start", *unit, b"end", b"same"])


def expected_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in ("".join(f"{s},{m},{q}\n" for s, m, q in runs), " ".join(kept))]
    start, length, period = best or (None, None, None)
    return (doc_id, len(runs), start, length, period, best and 1000 * length // period, *sha)


def test_query_is_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    found = QUERIES["op12_periodic_runs"](spark, SF_DIR)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert found.columns == names
    # Brute force takes the square of a text's words, so long texts of few words in common are left to the tests above.
    short = [r for r in rows if len((r[1] or "").split()) <= 1500]
    assert len(short) >= 0.95 * len(rows)
    got = {r.doc_id: tuple(r) for r in found.collect()}
    assert len(got) == len(rows) and sum(r[1] > 0 for r in got.values()) > 10
    assert [got[d] for d, _ in short] == [expected_row(d, t) for d, t in short]


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n\t", "c"), (None, "x x x x x x", "d"), (None, "x x x x x x", "d"), (None, None, None),
            (4, "é é é é é", "e"), (5, "a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb", "f"), (15, "one two " * 40, "g"), (15, "one", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter(map(tuple, QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()))
    assert got == collections.Counter(expected_row(d, t) for d, t, _ in rows)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    found = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    assert found[None].collapsed in ("x", "") and found[4].collapsed == "é é é é é" and found[5].collapsed == "a\x1cb"
