"""Quality rules: base limits, and boosted trees over document statistics, scored as flat numpy node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlake.llm.common import byte_values, unused
from grantlake.session import bound_batches

# Most labelled documents the trees are fitted on: those with the smallest hash of their id.
MAX_LABELLED = 20_000
# Share of labelled good documents that the score threshold may lose.
GOOD_LOSS = 0.002
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Fixed direction of the score in a feature: -1 never rises with it, 1 never falls, 0 free.
FEATURES = {
    "log_words": 0,
    "symbols_per_word": -1,
    "symbol_chars": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "word_length": 0,
    "distinct_words": 1,
    "line_words": 0,
    "lines_ending_in_stop": 0,
    "digit_share": 0,
    "upper_share": 0,
    "stop_share": 0,
}


def repeated_windows(ids: np.ndarray, width: int = 3) -> int:
    """Words inside windows of `width` words that occur twice or more; each word counts once."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    keys = ids.astype(np.int64)[:n]
    for i in range(1, width):
        _, keys = np.unique(keys * (len(ids) + 1) + ids[i : i + n], return_inverse=True)
    twice = np.bincount(keys)[keys] > 1
    inside = np.zeros(len(ids), dtype=bool)
    for i in range(width):
        inside[i : i + n] |= twice
    return int(inside.sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    """The counts of one text, and what only the trees look at."""
    text = text or b""
    words = text.split()
    n_words = len(words)
    word_bytes = text.translate(None, SPACES)
    chars = len(word_bytes) if word_bytes.isascii() else len(word_bytes.decode())
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.split()]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n_words)
    digits = len(text) - len(text.translate(None, b"0123456789"))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    stops = sum(line.rstrip(SPACES).endswith((b".", b"!", b"?")) for line in lines)
    return (
        n_words,
        chars,
        n_symbols,
        len(lines) - len(set(lines)),
        repeated_windows(ids) if n_words > len(known) else 0,
        len(known),
        len(lines),
        stops,
        digits,
        upper,
        text.count(b"."),
    )


def count_rows(texts: list[bytes | None]) -> np.ndarray:
    return np.array([counts(t) for t in texts], dtype=np.int64).reshape(len(texts), 11)


def features(rows: np.ndarray) -> np.ndarray:
    words, chars, symbols, dup_lines, repeats, distinct, lines, stops, digits, upper, full = rows.T.astype(float)
    w, c, n = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    columns = (
        np.log1p(words), symbols / w, symbols / c, dup_lines / n, repeats / w, chars / w,
        distinct / w, words / n, stops / n, digits / c, upper / c, full / w,
    )
    return np.column_stack(columns)


def base_failed(rows: np.ndarray) -> np.ndarray:
    return (rows[:, 0] < MIN_WORDS) | (100 * rows[:, 4] > MAX_REPEATED_PERCENT * rows[:, 0])


@dataclass
class Trees:
    """All nodes of all trees in flat arrays; a leaf points to itself. `roots` are the trees' first nodes."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float
    threshold: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality; every step moves all documents in all trees one level down."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return self.prior + self.value[at].sum(axis=1)


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    directions: tuple[int, ...],
    n_trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    n_bins: int = 64,
    ridge: float = 1.0,
    min_rows: int = 10,
    good_loss: float = GOOD_LOSS,
) -> Trees:
    """Logistic gradient boosting on binned features, with monotonic directions.

    A split against its feature's direction is not taken, and the subtrees of a split along it are kept on their sides
    of the middle of both values. Without two classes the trees are empty and everything passes.
    """
    if len(y) == 0 or y.min() == y.max():
        none = np.zeros(1)
        return Trees(np.zeros(1, int), none, np.zeros(1, int), np.zeros(1, int), none, np.zeros(1, int), 1, 0.0, -np.inf)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)])
    prior = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(len(y), prior)
    nodes: list[list[float]] = []
    roots = []

    def leaf_value(grad: float, hess: float, low: float, high: float) -> float:
        return float(np.clip(grad / (hess + ridge), low, high))

    def grow(rows: np.ndarray, level: int, low: float, high: float, grad: np.ndarray, hess: np.ndarray) -> int:
        at = len(nodes)
        g_all, h_all = grad[rows].sum(), hess[rows].sum()
        nodes.append([0, 0.0, at, at, rate * leaf_value(g_all, h_all, low, high)])
        if level == depth or len(rows) < 2 * min_rows:
            score[rows] += nodes[at][4]
            return at
        best = (1e-6, None)
        for j, direction in enumerate(directions):
            width = len(edges[j]) + 1
            g = np.cumsum(np.bincount(binned[rows, j], grad[rows], width))[:-1]
            h = np.cumsum(np.bincount(binned[rows, j], hess[rows], width))[:-1]
            n = np.cumsum(np.bincount(binned[rows, j], minlength=width))[:-1]
            left, right = np.clip(g / (h + ridge), low, high), np.clip((g_all - g) / (h_all - h + ridge), low, high)
            gain = g**2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all**2 / (h_all + ridge)
            gain[(n < min_rows) | (len(rows) - n < min_rows) | (direction * (right - left) < 0)] = -1
            if len(gain) and gain.max() > best[0]:
                k = int(gain.argmax())
                best = (gain[k], (j, k, left[k], right[k]))
        if best[1] is None:
            score[rows] += nodes[at][4]
            return at
        j, k, left, right = best[1]
        middle = (left + right) / 2
        lows, highs = (low, low), (high, high)
        if directions[j]:
            lows, highs = ((low, middle), (middle, high)) if directions[j] > 0 else ((middle, low), (high, middle))
        goes_left = binned[rows, j] <= k
        nodes[at][0], nodes[at][1] = j, edges[j][k]
        nodes[at][2] = grow(rows[goes_left], level + 1, lows[0], highs[0], grad, hess)
        nodes[at][3] = grow(rows[~goes_left], level + 1, lows[1], highs[1], grad, hess)
        return at

    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf, y - p, p * (1 - p)))
    flat = np.array(nodes)
    trees = Trees(
        flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4],
        np.array(roots), depth, prior, 0.0,
    )
    good = np.sort(trees.scores(x)[y == 1])
    trees.threshold = min(0.0, float(good[int(good_loss * len(good))]))
    return trees


def labelled_counts(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Counts and quality of at most `max_labelled` labelled documents (smallest hash of the id first).

    Only these ids are broadcast. Conflicting labels of one id average and count as good from one half; of several
    documents with one id, the one with the smallest text hash counts.
    """
    quality = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("q"))
    chosen = quality.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    counted = bound_batches(joined).mapInArrow(_count_labelled, "doc_id long, q double, h long, counts array<long>")
    rows = counted.groupBy("doc_id").agg(F.min(F.struct("h", "q", "counts")).alias("r")).select("doc_id", "r.*").toPandas()
    rows = rows.sort_values("doc_id")
    found = np.array(rows["counts"].tolist(), dtype=np.int64).reshape(len(rows), 11)
    return found, (rows["q"].to_numpy() >= 0.5).astype(float)


def _count_labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        texts = byte_values(batch.column("text"))
        found = count_rows(texts)
        hashes = pa.array([xxhash.xxh64_intdigest(t or b"") >> 1 for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("q").cast(pa.float64()), hashes, pa.array(list(found), pa.list_(pa.int64()))],
            ["doc_id", "q", "h", "counts"],
        )


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Trees:
    found, good = labelled_counts(docs, labels, max_labelled)
    return fit_trees(features(found), good, tuple(FEATURES.values()))


def quality_rules(docs: DataFrame, trees: Trees) -> DataFrame:
    """All columns of `docs` and `_n_words, _word_chars, _n_symbols, _n_dup_lines, _n_repeat_words, _score, _base_failed, _kept`.

    One pass without a shuffle. A null text counts as empty and fails the base limits. Columns of `docs` pass through,
    whatever they are called, unless they have one of these names: those are replaced.
    """
    added = [f"_{c}" for c in (*COUNTS, "score", "base_failed", "kept")]
    own = [c for c in docs.columns if c not in added]
    schema = docs.select(*own).schema
    for name in added[:5]:
        schema = schema.add(name, "long")
    schema = schema.add("_score", "double").add("_base_failed", "boolean").add("_kept", "boolean")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = count_rows(byte_values(batch.column("text")))
            score = trees.scores(features(rows))
            failed = base_failed(rows)
            columns = [*batch.columns, *[pa.array(rows[:, i]) for i in range(5)], pa.array(score), pa.array(failed)]
            columns.append(pa.array(~failed & (score >= trees.threshold)))
            yield pa.RecordBatch.from_arrays(columns, [*own, *added])

    return bound_batches(docs.select(*own)).mapInArrow(judge, schema)


def good_documents(docs: DataFrame, trees: Trees) -> DataFrame:
    """The documents that the rules keep, with all their columns as they are, whatever they are called."""
    renamed = docs
    names = []
    for name in docs.columns:
        names.append(unused(renamed, name) if name.startswith("_") else name)
        renamed = renamed.withColumnRenamed(name, names[-1])
    kept = quality_rules(renamed, trees).where("_kept")
    return kept.select(*[F.col(f"`{new}`").alias(name) for new, name in zip(names, docs.columns)])
