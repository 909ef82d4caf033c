"""Periodic run detection: exact runs of repeated words, by extensions in a recompressed grammar from a harmonic grid."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.llm.common import byte_values
from grantlake.llm.recompression import Grammar
from grantlake.session import bound_batches

# A run has a period q and at least max(LEAST_WORDS, LEAST_PERIODS * q) words.
LEAST_WORDS, LEAST_PERIODS = 6, 4
# Words whose documents are worked on together, and grid places looked at together.
GROUP_WORDS, GRID_PLACES = 200_000, 1_000_000
RUNS = "array<struct<start:long,length:long,period:long>>"


def grid_candidates(x: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`document, period, place` where a run may have its first multiple of the period (counted from the document's start).

    A run of at least four periods holds the three multiples of its period after the first, so words one period apart
    agree from the first to the third; some of them are compared here. Every run has its place among the candidates.
    """
    periods = lengths // LEAST_PERIODS
    document = np.repeat(np.arange(len(lengths)), periods)
    period = np.arange(len(document)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    places = (lengths[document] - 1) // np.maximum(period, 1) - (LEAST_PERIODS - 2)
    found: list[tuple[np.ndarray, ...]] = []
    sums = np.cumsum(places)
    at = 0
    while at < len(places):
        stop = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + GRID_PLACES, "right")))
        n = places[at:stop]
        pair = np.repeat(np.arange(at, stop), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        p = period[pair]
        place = starts[document[pair]] + k * p
        for part, after in ((0, 0), (0, 1), (0, 2), (2, 0), (2, 1), (1, 0), (3, 0), (1, 1), (3, 1)):
            one = place + part * p // 4 + after * p
            keep = np.flatnonzero(x[one] == x[one + p])
            pair, place, p = pair[keep], place[keep], p[keep]
        found.append((document[pair], p, place))
        at = stop
    if not found:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(parts) for parts in zip(*found))


def find_runs(x: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """The runs of each document, rows (start, length, period) by start, then period; `x` has the documents' words one after another."""
    starts = np.cumsum(lengths) - lengths
    document, period, place = grid_candidates(x, starts, lengths)
    none = np.empty((0, 3), np.int64)
    if not len(document):
        return [none] * len(lengths)
    # Only documents with candidates are compressed, with a separator before, between and after them.
    own = np.unique(document)
    ends_at = np.concatenate([[0], np.cumsum(lengths[own] + 1)])
    y = np.zeros(ends_at[-1] + 1, np.int64)
    is_end = np.zeros(len(y), bool)
    is_end[ends_at] = True
    y[ends_at] = x.max() + 1 + np.arange(len(ends_at))
    y[~is_end] = np.concatenate([x[starts[d] : starts[d] + lengths[d]] for d in own])
    shift = np.zeros(len(lengths), np.int64)
    shift[own] = ends_at[:-1] + 1 - starts[own]
    place = place + shift[document]
    forward, backward = Grammar(y, is_end), Grammar(y[::-1], is_end[::-1])
    # Candidates of one run are neighbours on the grid, so each streak of neighbours is asked by its first until it is used up.
    streak = np.cumsum(np.concatenate([[True], (np.diff(document) != 0) | (np.diff(period) != 0) | (np.diff(place) != period[1:])]))
    found = []
    while len(place):
        first = np.concatenate([[True], streak[1:] != streak[:-1]])
        at, p = place[first], period[first]
        after = forward.extensions(at, at + p)
        last = len(y) - 1
        before = backward.extensions(last - (at + p - 1), last - (at - 1))
        length = p + after + before
        whole = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
        found.append(np.column_stack([document[first], at - before - shift[document[first]], length, p])[whole])
        stop = (at + p + after)[np.cumsum(first) - 1]
        keep = place + period >= stop
        place, period, document, streak = place[keep], period[keep], document[keep], streak[keep]
    # A stretch is found once for each multiple of its period; the smallest is the period.
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[new]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    rows[:, 1] -= starts[rows[:, 0]]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(lengths) + 1))
    return [rows[a:b, 1:] for a, b in zip(cuts, cuts[1:])]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:n]) == 0


def strongest(runs: np.ndarray) -> int | None:
    """The run of the largest exact length / period; of equal ones that of the smallest start, then period."""
    best = None
    for i, (_, length, period) in enumerate(runs.tolist()):
        if best is None or length * runs[best][2] > runs[best][1] * period:
            best = i
    return best


def _groups(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    group, n = [], 0
    for text in texts:
        group.append((text or b"").split())
        n += len(group[-1])
        if n >= GROUP_WORDS:
            yield group
            group, n = [], 0
    if group:
        yield group


def text_runs(texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, bytes]]:
    """The runs of each text, and its words without repeats joined by spaces."""
    for group in _groups(texts):
        known: dict[bytes, int] = {}
        lengths = np.array([len(words) for words in group], np.int64)
        x = np.fromiter((known.setdefault(w, len(known)) for words in group for w in words), np.int64, int(lengths.sum()))
        for words, runs in zip(group, find_runs(x, lengths)):
            if len(runs):
                words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
            yield runs, b" ".join(words)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """`doc_id, runs, strongest, collapsed` for every row of `docs`: runs as structs of start, length and period in words.

    Words are runs of anything but ASCII white space. `strongest` is the run of the largest length / period, null without
    runs; `collapsed` the text without the words that repeat a run's first period. A null or empty text has no runs and
    collapses to the empty text. Rows are independent of each other, so ties, repeated rows and null ids change nothing; other
    columns are not read, whatever they are called. One pass without a shuffle.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, texts = zip(*text_runs(byte_values(batch.column("text"))))
            rows = np.concatenate(runs)
            structs = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], fields=list(numbers))
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
            best = [(strongest(r) if len(r) else None) for r in runs]
            top = pa.array([None if b is None else dict(zip(("start", "length", "period"), r[b].tolist())) for r, b in zip(runs, best)], numbers)
            columns = [batch.column("doc_id"), lists, top, pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "runs", "strongest", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = f"doc_id long, runs {RUNS}, strongest struct<start:long,length:long,period:long>, collapsed string"
    return bound_batches(rows).mapInArrow(find, schema)


def printed_runs(runs: Column) -> Column:
    """`start,length,period` and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """`doc_id, text` where a tenth of the documents, told by crc32 of the id, repeat a part of their words to the end.

    With h that checksum, g = h // 10 and n words, each word from a = g % n on becomes the word at a + (i - a) % p, where
    p = 1 + (n - a) // (3 + g % 8), if h % 10 is 0. Other texts, and texts of null ids, stay as they are.
    """

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_values(batch.column("text"))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
                words = (texts[k] or b"").split() if h % 10 == 0 else []
                if words:
                    g = h // 10
                    a = g % len(words)
                    tail = len(words) - a
                    unit = words[a : a + 1 + tail // (3 + g % 8)]
                    texts[k] = b" ".join(words[:a] + (unit * (tail // len(unit) + 1))[:tail])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return bound_batches(rows).mapInArrow(repeat, "doc_id long, text string")
