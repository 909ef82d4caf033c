"""Toxicity: a logistic model of words whose scores are held still when identity terms are swapped in labelled sentences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from grantlake.llm.common import cut
from grantlake.session import bound_batches

# Most labelled documents the model is fitted on: those with the smallest hash of their id.
MAX_LABELLED = 10_000
# Documents whose crc32(doc_id as text) is divisible by this are held out: their labels are never read.
FOLDS = 5
# Most features of a model, and the documents a feature must be in.
MAX_FEATURES, MIN_DOCUMENTS = 1024, 3
# Prefixes of words that are features beside the whole words.
PREFIXES = (4, 5, 6)
# A feature counts the distinct words of a document that have it, up to this.
MAX_COUNT = 4
# Weight of the squared weights, and of squared score changes under a swap.
RIDGE, SWAP_WEIGHT = 0.5, 20.0
# Distinct words a task remembers the features of.
MAX_KNOWN_WORDS = 500_000
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"[.!?\n]+")

# Identity terms by group. A term may be swapped for any other of its group; the last one of each names no group.
IDENTITY_GROUPS = (
    ("woman", "man", "girl", "boy", "lady", "gentleman", "person"),
    ("women", "men", "girls", "boys", "ladies", "gentlemen", "females", "males", "people"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist", "local"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists", "neighbours"),
    ("gay", "lesbian", "bisexual", "transgender", "queer", "straight", "heterosexual", "homosexual", "trans", "human"),
    ("black", "white", "asian", "african", "european", "american", "latino", "hispanic", "arab", "indigenous", "many"),
    ("immigrant", "refugee", "foreigner", "migrant", "native", "citizen"),
    ("immigrants", "refugees", "foreigners", "migrants", "natives", "citizens"),
    ("blind", "deaf", "disabled", "autistic", "elderly", "old", "young", "other"),
    ("frau", "mann", "mädchen", "junge", "person"),
    ("frauen", "männer", "mädchen", "jungen", "leute"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "katholiken", "nachbarn"),
    ("ausländer", "flüchtlinge", "migranten", "einwanderer", "bürger"),
    ("schwule", "lesben", "behinderte", "alte", "andere"),
    ("femme", "homme", "fille", "garçon", "personne"),
    ("femmes", "hommes", "filles", "garçons", "gens"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "catholiques", "voisins"),
    ("étrangers", "réfugiés", "migrants", "immigrés", "citoyens"),
    ("homosexuels", "lesbiennes", "handicapés", "vieux", "autres"),
    ("mujer", "hombre", "niña", "niño", "persona"),
    ("mujeres", "hombres", "niñas", "niños", "personas"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "católicos", "vecinos"),
    ("extranjeros", "refugiados", "migrantes", "inmigrantes", "ciudadanos"),
    ("gays", "lesbianas", "discapacitados", "viejos", "otros"),
)


def distinct_words(text: str) -> set[str]:
    """The runs of letters of a text in lower case."""
    return set(LETTERS.findall(text.lower()))


def word_features(word: str) -> list[str]:
    return ["=" + word, *[word[:n] for n in PREFIXES if len(word) >= n]]


def swaps(groups: Iterable[tuple[str, ...]] = IDENTITY_GROUPS) -> dict[str, list[str]]:
    """Each identity term with the others it may be swapped for; a term of several groups keeps the first."""
    found: dict[str, list[str]] = {}
    for group in groups:
        for i, term in enumerate(group):
            found.setdefault(term, [*group[i + 1 :], *group[:i]])
    return found


def swapped_words(text: str, swap: dict[str, list[str]]) -> list[set[str]]:
    """The distinct words of the text after each swap: its sentences with identity terms have each term moved on in its group."""
    plain: set[str] = set()
    named: list[list[str]] = []
    for sentence in SENTENCE_END.split(text.lower()):
        words = LETTERS.findall(sentence)
        if any(w in swap for w in words):
            named.append(words)
        else:
            plain.update(words)
    terms = {w for words in named for w in words if w in swap}
    steps = max((len(swap[t]) for t in terms), default=0)
    versions = []
    for step in range(steps):
        moved = {w: swap[w][step % len(swap[w])] for w in terms}
        versions.append(plain | {moved.get(w, w) for words in named for w in words})
    return versions


def held_out() -> Column:
    """Whether a document's labels are never read. A null id has no label and is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


@dataclass
class Model:
    """Weights of features; the log-odds of a text are the bias and the weighted counts of its distinct words."""

    features: dict[str, int]
    weights: np.ndarray
    bias: float

    def log_odds(self, texts: Iterable[str], known: dict[str, tuple[int, ...]] | None = None) -> np.ndarray:
        """Log-odds of each text; `known` carries the features of words from one batch to the next."""
        known = {} if known is None else known
        found = []
        for text in texts:
            if len(known) > MAX_KNOWN_WORDS:
                known.clear()
            counts = feature_counts(distinct_words(text), self.features, known)
            found.append(self.bias + sum(self.weights[f] * min(n, MAX_COUNT) for f, n in sorted(counts.items())))
        return np.array(found, dtype=float)

    def scores(self, texts: Iterable[str], known: dict[str, tuple[int, ...]] | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(texts, known), -500, 500)))

    def evidence(self, text: str) -> list[str]:
        """The distinct words of a text that raise its score, in order."""
        own = {w: sum(self.weights[self.features[f]] for f in word_features(w) if f in self.features) for w in distinct_words(text)}
        return sorted(w for w, weight in own.items() if weight > 0)


def feature_counts(words: set[str], features: dict[str, int], known: dict[str, tuple[int, ...]]) -> Counter:
    """How many of the words have each feature; `known` remembers the features of words."""
    counts: Counter = Counter()
    for word in words:
        own = known.get(word)
        if own is None:
            own = known[word] = tuple(features[f] for f in word_features(word) if f in features)
        if own:
            counts.update(own)
    return counts


def fit_logistic(x: np.ndarray, y: np.ndarray, moves: np.ndarray, ridge: float = RIDGE, swap_weight: float = SWAP_WEIGHT) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the log-loss, `ridge` times their squares and `swap_weight` times the squared score
    changes of the `moves` (features before less features after a swap); Newton's method, a fixed number of steps."""
    n, width = x.shape
    if n == 0 or y.min() == y.max():
        # One class alone says nothing: every score is the share of toxic labels, kept inside 0 and 1.
        share = (y.sum() + 0.5) / (n + 1) if n else 0.0
        return np.zeros(width), float(np.log(max(share, 1e-3) / (1 - min(share, 1 - 1e-3))))
    design = np.column_stack([x, np.ones(n, x.dtype)])
    fixed = np.zeros((width + 1, width + 1))
    fixed[:width, :width] = ridge * np.eye(width)
    if len(moves):
        fixed[:width, :width] += swap_weight * (moves.T @ moves).astype(float)
    fixed[width, width] = 1e-6
    w = np.zeros(width + 1)
    w[width] = np.log(y.mean() / (1 - y.mean()))

    def loss(at: np.ndarray) -> float:
        z = design @ at
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * at @ fixed @ at)

    current = loss(w)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (y - p) - fixed @ w
        weighted = design * np.sqrt(p * (1 - p))[:, None]
        step = np.linalg.solve(weighted.T @ weighted + fixed + 1e-9 * np.eye(width + 1), gradient)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > current:
            size /= 2
        w = w + size * step
        after = loss(w)
        if current - after < 1e-7 * abs(current):
            break
        current = after
    return w[:width], float(w[width])


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other documents of a batch each feature is."""
    for batch in batches:
        ids: dict[str, int] = {}
        known: dict[str, list[int]] = {}
        parts: tuple[list, list] = ([], [])
        for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist()):
            own: set[int] = set()
            for word in distinct_words(text):
                if word not in known:
                    known[word] = [ids.setdefault(f, len(ids)) for f in word_features(word)]
                own.update(known[word])
            parts[int(toxic)].append(np.fromiter(own, np.int64, len(own)))
        if ids:
            other, toxic = (np.bincount(np.concatenate(p) if p else np.empty(0, np.int64), minlength=len(ids)) for p in parts)
            yield pa.RecordBatch.from_arrays([pa.array(list(ids)), pa.array(toxic), pa.array(other)], ["feature", "toxic", "other"])


def labelled_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """`doc_id, text, toxic` of at most `max_labelled` labelled documents that are not held out, smallest hash of the id first.

    A document is toxic if any of its labels says so. Of several rows with one id, the one with the smallest text counts.
    """
    named = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    marks = named.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def select_features(labelled: DataFrame, max_features: int = MAX_FEATURES) -> list[str]:
    """The features whose presence tells toxic documents best (G-test), among those more frequent in toxic ones."""
    sizes = labelled.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    n_toxic, n_other = float(sizes["t"]), float(sizes["n"] - sizes["t"])
    if not n_toxic or not n_other:
        return []
    counted = bound_batches(labelled.select("text", "toxic")).mapInArrow(_count_features, "feature string, toxic long, other long")
    by_feature = counted.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    frequent = by_feature.where((F.col("t") + F.col("o") >= MIN_DOCUMENTS) & (F.col("t") * n_other > 2 * F.col("o") * n_toxic))
    present, size = F.col("t") + F.col("o"), n_toxic + n_other

    def part(count: Column, rows: Column | float, column: float) -> Column:
        return F.when(count > 0, count * F.log(count * size / (rows * column))).otherwise(0.0)

    absent = size - present
    gain = (
        part(F.col("t"), present, n_toxic) + part(F.col("o"), present, n_other)
        + part(n_toxic - F.col("t"), absent, n_toxic) + part(n_other - F.col("o"), absent, n_other)
    )
    # Rounded, because equal counts summed in another order must not change the choice.
    best = frequent.select("feature", F.round(gain, 6).alias("gain")).orderBy(F.desc("gain"), "feature").limit(max_features)
    return [r.feature for r in best.collect()]


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = MAX_LABELLED,
    swap_weight: float = SWAP_WEIGHT,
    groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS,
) -> Model:
    """The model of the labelled documents that are not held out.

    At most `max_labelled` documents and MAX_FEATURES counts of each are gathered on the driver; features are chosen by
    counts that stay sharded. Without labels of both kinds there are no features and all scores are equal.
    """
    labelled = cut(labelled_documents(docs, labels, max_labelled))
    features = {f: i for i, f in enumerate(select_features(labelled))}
    swap = swaps(groups)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, toxic in zip(batch.column("doc_id").to_pylist(), _texts(batch), batch.column("toxic").to_pylist()):
                versions = [distinct_words(text), *swapped_words(text, swap)]
                for step, words in enumerate(versions):
                    counts = sorted(feature_counts(words, features, known).items())
                    rows.append((doc_id, step, len(versions) - 1, toxic, [f for f, _ in counts], [min(n, MAX_COUNT) for _, n in counts]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    names = ["doc_id", "step", "steps", "toxic", "features", "counts"]
    numbers = pa.list_(pa.int32())
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), numbers, numbers)
    schema = "doc_id long, step int, steps int, toxic int, features array<int>, counts array<int>"
    ids = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic")
    rows = bound_batches(ids).mapInArrow(vectors, schema).toPandas().sort_values(["doc_id", "step"])
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, (own, counts) in enumerate(zip(rows["features"], rows["counts"])):
        x[i, np.asarray(own, int)] = counts
    step = rows["step"].to_numpy()
    first = np.flatnonzero(step == 0)
    own = first[np.cumsum(step == 0) - 1]
    # The swaps of one document weigh as one change together.
    share = np.sqrt(1 / np.maximum(rows["steps"].to_numpy(), 1)).astype(np.float32)
    moves = ((x[own] - x) * share[:, None])[step > 0]
    weights, bias = fit_logistic(x[first], rows["toxic"].to_numpy(float)[first], moves[np.abs(moves).any(axis=1)], swap_weight=swap_weight)
    return Model(features, weights, bias)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id, held_out, score, predicted, evidence` for every row of `docs`, in one pass without a shuffle.

    A null text is an empty one and has the score of the bias alone. Repeated rows are scored alike; other columns of
    `docs` are not read, whatever they are called. `evidence` lists the words that raise the score of texts at or above one half.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            texts = _texts(batch)
            found = model.scores(texts, known)
            words = [model.evidence(t) if s >= 0.5 else [] for t, s in zip(texts, found)]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(found), pa.array(words, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "evidence"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    schema = rows.drop("text").schema.add("score", "double").add("evidence", ArrayType(StringType()))
    scored = bound_batches(rows).mapInArrow(score, schema)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
