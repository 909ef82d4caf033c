"""Phrase collocations: exact counts of phrases over a prefix-free parse of the texts, and the phrases that hold together best.

Texts are cut into pieces at punctuation and line ends, and pieces into overlapping chunks wherever a window of words is a
trigger by its content. Equal passages fall into equal chunks, so phrases are counted in the distinct chunks only, each with
the number of times it is in the parse. A phrase belongs to the chunk it begins in before that chunk's overlap with the next.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grantlake.llm.common import byte_values, cut, mixed, new_folder
from grantlake.session import bound_batches

# Longest phrase, and the words of a trigger window; chunks overlap by a window, so a phrase is whole in the chunk it begins in.
MOST_WORDS = 4
WINDOW = MOST_WORDS - 1
# One window in so many is a trigger.
TRIGGER = 16
# Occurrences a candidate needs, phrases returned for each language.
MIN_COUNT, TOP = 30, 2000
# A candidate goes if a longer one holds it in so many of a hundred of its occurrences.
COVERED = 80
# Text, and words of chunks, that a task works on at a time.
TEXT_BYTES, CHUNK_WORDS = 4 * 1024 * 1024, 600_000
# Bits of the screen of frequent pairs: so many for each pair, at most this many.
BITS_PER_PAIR, MAX_BITS = 16, 1 << 27
# Groups a language's candidates are ranked in before the last ranking.
RANK_GROUPS = 64
# Bytes that end a piece, and A-Z in lower case; a tab is a blank.
STOPS = b".,;:!?\n\x0b\x0c\r"
NORMAL = bytes.maketrans(STOPS + b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * len(STOPS) + b" abcdefghijklmnopqrstuvwxyz")


def language() -> Column:
    return F.coalesce("lang", F.lit("und")).alias("lang")


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word, scattered."""
    lengths = stops - starts
    offsets = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(offsets, lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    values = (data[np.repeat(starts, lengths) + at].astype(np.uint64) + np.uint64(1)) * powers[at]
    return mixed(np.add.reduceat(values, offsets))


def chunks(texts: list[bytes], trigger: int = TRIGGER) -> tuple[list[bytes], np.ndarray]:
    """The chunks of all texts, words joined by single spaces, and how many words of each belong to it alone."""
    data = np.frombuffer(b"\n".join(texts).translate(NORMAL) + b"\n", np.uint8)
    inside = (data != 32) & (data != 10)
    edges = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    n = len(starts)
    if not n:
        return [], np.empty(0, np.int64)
    piece = np.cumsum(data == 10)[starts]
    new = np.ones(n + 1, bool)
    new[1:n] = piece[1:] != piece[:-1]
    if n >= WINDOW:
        hashes = word_hashes(data, starts, stops)
        window = np.zeros(n - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            window = mixed(window ^ hashes[i : n - WINDOW + 1 + i])
        cuts = (window % np.uint64(trigger) == 0) & (piece[: n - WINDOW + 1] == piece[WINDOW - 1 :])
    else:
        cuts = np.zeros(0, bool)
    begins = new.copy()
    begins[: len(cuts)] |= cuts
    at = np.flatnonzero(begins)
    first, after = at[:-1], at[1:]
    last = np.where(new[after], after - 1, after + WINDOW - 1)
    # The blank after a word is kept once, all others go.
    kept = inside.copy()
    kept[stops] = True
    place = np.cumsum(kept) - 1
    text = np.where(inside, data, 32).astype(np.uint8)[kept].tobytes()
    ranges = zip(place[starts[first]].tolist(), place[stops[last]].tolist())
    return [text[a:b] for a, b in ranges], after - first


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct chunks of some megabytes of text with their frequency in the parse."""
    texts: dict[str, list[bytes]] = {}
    size = 0

    def parsed() -> Iterator[pa.RecordBatch]:
        for lang, own in texts.items():
            found, alone = chunks(own)
            counts = Counter(zip(found, alone.tolist()))
            if counts:
                (words, alone), n = zip(*counts), list(counts.values())
                columns = [pa.array([lang] * len(n)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(alone, pa.int64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "alone", "n"])
        texts.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), byte_values(batch.column("text"))):
            if text:
                texts.setdefault(lang, []).append(text)
                size += len(text)
                if size >= TEXT_BYTES:
                    yield from parsed()
                    size = 0
    yield from parsed()


def parse(docs: DataFrame) -> DataFrame:
    """`lang, chunk, alone, n`: the dictionary of distinct chunks with their frequencies, written to the shared folder."""
    rows = bound_batches(docs.select(language(), "text")).mapInArrow(_parse, "lang string, chunk string, alone long, n long")
    path = new_folder(docs.sparkSession, "chunks")
    rows.groupBy("lang", "chunk", "alone").agg(F.sum("n").alias("n")).write.parquet(path, compression="zstd")
    return docs.sparkSession.read.parquet(path)


class Chunks:
    """Words of many chunks of one language as numbers, with the place in their chunk and the chunk's frequency."""

    def __init__(self, texts: list[bytes], alone: np.ndarray, n: np.ndarray) -> None:
        lengths = np.array([t.count(b" ") for t in texts], np.int64) + 1
        known: dict[bytes, int] = {}
        self.ids = np.array([known.setdefault(w, len(known)) for w in b" ".join(texts).split(b" ")], np.int64)
        self.words = list(known)
        self.text = pa.array(self.words, pa.binary()).cast(pa.string())
        at = np.arange(len(self.ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.left = np.repeat(lengths, lengths) - at
        self.own = at < np.repeat(alone, lengths)
        self.n = np.repeat(n, lengths)

    def begins(self, size: int) -> np.ndarray:
        """Where a phrase of `size` words begins that belongs to its chunk."""
        return np.flatnonzero(self.own & (self.left >= size))

    def sums(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct key, one of its places and the sum of its frequencies."""
        order = np.argsort(keys)
        new = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(keys) else np.empty(0, np.int64)
        return at[order[new]], np.add.reduceat(self.n[at[order]], new) if len(new) else np.empty(0, np.int64)

    def batch(self, lang: str, size: int, places: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        parts = [self.text.take(pa.array(self.ids[places + k])) for k in range(size)]
        return phrase_batch(lang, size, parts[0] if size == 1 else pc.binary_join_element_wise(*parts, " "), counts)


def phrase_batch(lang: str, size: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    columns = [pa.repeat(pa.scalar(lang, pa.string()), n), pa.array(np.full(n, size, np.int32)), phrases, pa.array(counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "size", "phrase", "f"])


def _by_language(batches: Iterator[pa.RecordBatch], count: Callable) -> Iterator[pa.RecordBatch]:
    """`count(lang, chunks)` for some millions of words of one language at a time."""
    held: dict[str, list[tuple]] = {}
    n_words = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, rows in held.items():
            texts, alone, n = zip(*rows)
            yield from count(lang, Chunks(list(texts), np.array(alone, np.int64), np.array(n, np.int64)))
        held.clear()

    for batch in batches:
        columns = (byte_values(batch.column("chunk")), batch.column("alone").to_pylist(), batch.column("n").to_pylist())
        for lang, *row in zip(batch.column("lang").to_pylist(), *columns):
            held.setdefault(lang, []).append(tuple(row))
            n_words += row[1] + WINDOW
        if n_words >= CHUNK_WORDS:
            yield from counted()
            n_words = 0
    yield from counted()


def _short_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and pairs with their counts; the empty phrase counts all words."""

    def count(lang: str, found: Chunks) -> Iterator[pa.RecordBatch]:
        one, two = found.begins(1), found.begins(2)
        yield phrase_batch(lang, 0, pa.array([""]), found.n[one].sum(keepdims=True))
        yield found.batch(lang, 1, *found.sums(found.ids[one], one))
        yield found.batch(lang, 2, *found.sums(found.ids[two] * len(found.words) + found.ids[two + 1], two))

    return _by_language(batches, count)


def word_marks(lang: str, words: list[bytes]) -> np.ndarray:
    """Hashes of words, as `screen` takes them (Spark's xxhash64 of language and word)."""
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)


def pair_bits(first: np.ndarray, second: np.ndarray, n_bits: int) -> np.ndarray:
    """Both bits of pairs of words with these hashes."""
    hashes = first ^ (second << np.uint64(1))
    return np.stack([hashes % np.uint64(n_bits), (hashes >> np.uint64(32)) % np.uint64(n_bits)])


def screen(pairs: DataFrame) -> np.ndarray:
    """A bit table of the frequent pairs: at most MAX_BITS bits, whatever the number of pairs.

    A pair that is not frequent may pass it, a frequent one always does: what passes is counted, so counts stay exact. With
    many more pairs than bits everything passes.
    """
    n_bits = min(MAX_BITS, max(64, 1 << (BITS_PER_PAIR * pairs.count()).bit_length()))
    first, second = (F.xxhash64("lang", F.substring_index("phrase", " ", i)) for i in (1, -1))
    mask, h = F.lit(n_bits - 1).cast("long"), first.bitwiseXOR(F.shiftleft(second, 1))
    bits = pairs.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask))).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit & 63 AS int))")
    words = bits.groupBy(F.expr("shiftright(bit, 6)").cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    table = np.zeros(n_bits // 64, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return table


def phrase_counts(chunks: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """`lang, size, phrase, f` of all phrases of up to MOST_WORDS words with f >= min_count; size 0 counts all words.

    A phrase that is frequent holds only frequent pairs, so longer ones are counted where all their pairs pass the screen.
    """
    schema = "lang string, size int, phrase string, f long"

    def summed(rows: DataFrame) -> DataFrame:
        whole = rows.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
        return cut(whole.where((F.col("f") >= min_count) | (F.col("size") == 0)))

    short = summed(chunks.mapInArrow(_short_phrases, schema))
    table = chunks.sparkSession.sparkContext.broadcast(screen(short.where("size = 2")))

    def long_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def count(lang: str, found: Chunks) -> Iterator[pa.RecordBatch]:
            # Pairs of the overlap take part, because they are within phrases that begin before it.
            two = np.flatnonzero(found.left >= 2)
            keys, ranks = np.unique(found.ids[two] * len(found.words) + found.ids[two + 1], return_inverse=True)
            marks = word_marks(lang, found.words)
            bits = pair_bits(*(marks[i] for i in divmod(keys, len(found.words))), 64 * len(table.value))
            passed = ((table.value[bits >> np.uint64(6)] >> (bits & np.uint64(63))) & np.uint64(1)).all(axis=0)
            # The rank of the pair that begins at each word, -1 where it is not frequent.
            rank = np.full(len(found.ids) + MOST_WORDS, -1, np.int64)
            rank[two] = np.where(passed[ranks], ranks, -1)
            for size in range(3, MOST_WORDS + 1):
                at = found.begins(size)
                for i in range(size - 1):
                    at = at[rank[at + i] >= 0]
                # Pairs two words apart, and the last word where one is left over, name the phrase.
                key = rank[at]
                for i in range(2, size - 1, 2):
                    key = np.unique(key * (len(keys) + 1) + rank[at + i], return_inverse=True)[1]
                if size % 2:
                    key = key * len(found.words) + found.ids[at + size - 1]
                yield found.batch(lang, size, *found.sums(key, at))

        return _by_language(batches, count)

    return short.unionByName(summed(chunks.mapInArrow(long_phrases, schema)))


def best_cuts(counts: DataFrame) -> DataFrame:
    """`lang, phrase, a, l, r, score` of each candidate at its lowest-scoring cut; ties take the shortest first part."""
    words = F.split("phrase", " ")
    named = counts.where("size >= 2").select("lang", "phrase", F.col("f").alias("a"), "size", words.alias("w"))
    at = named.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    parts = at.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    known = counts.where(f"size BETWEEN 1 AND {MOST_WORDS - 1}")
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    joined = parts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    wide = "cast(2000000 * cast(a AS decimal(28, 0)) AS decimal(38, 0)) div (cast(l AS decimal(20, 0)) + r)"
    scored = joined.withColumn("score", F.expr(wide).cast("long"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("m"))
    return lowest.select("lang", "phrase", "m.a", "m.l", "m.r", "m.score")


def covered_phrases(counts: DataFrame) -> DataFrame:
    """`lang, phrase, longer`: the largest count of a longer candidate that holds the phrase, for all that are held."""
    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(w, i, n), ' '))))"
    )
    longer = counts.where("size >= 3").select("lang", "f", "size", F.split("phrase", " ").alias("w"))
    held = longer.select("lang", "f", F.explode(inner).alias("phrase"))
    return held.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """`lang, rank, phrase, a, l, r, n, score`: the `top` phrases of each language by score, a and phrase.

    A null text is empty, a null lang is `und`; rows that repeat count as often as they are there, other columns are not
    read. A table without words gives no rows. Counts cover all texts and are exact.
    """
    counts = cut(phrase_counts(parse(docs), min_count))
    found = best_cuts(counts).join(covered_phrases(counts), ["lang", "phrase"], "left")
    wide = [F.col(c).cast("decimal(30,0)") for c in ("longer", "a")]
    kept = found.where(F.col("longer").isNull() | (100 * wide[0] < COVERED * wide[1]))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Ranked in groups first, so that the last ranking sees a bounded number of rows of a language.
    group = F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))
    grouped = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", group).orderBy(*order)))
    best = grouped.where(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    words = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.where(F.col("rank") <= top).join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
