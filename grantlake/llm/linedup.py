"""Line dedup: an exact set-similarity join of lines with prefix, positional and length filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grantlake.llm.common import broadcast_if_small, byte_values, cut, mixed, sorted_set, unused
from grantlake.llm.neardup import SHINGLE_WORDS, SIMILARITY
from grantlake.session import bound_batches

# A line's tokens are its word shingles. A line with fewer words has one token, all its words: it is similar to equal lines
# alone, which its digest tells, so it needs no rows of the join.
MIN_WORDS = SHINGLE_WORDS
# Token counts are kept in a table of fixed size, which travels to every task.
COUNT_BITS = 16
# Longer words (in bytes) are hashed one by one.
LONG_WORD = 256
# A sorting key holds line, rarity and token.
LINE_BITS, RARITY_BITS, TOKEN_BITS = 14, 6, 44
SIZE_BITS = 10
MAX_SIZE = (1 << SIZE_BITS) - 1
# Up to so many lines with one token are paired at once; more are paired with the first, then settled exactly.
SMALL_RUN = 32
# Places of the parity bits of a token set.
BITS = 256
BIT_NAMES = [f"bits{k}" for k in range(BITS // 64)]
BITS_LINES = 4096
FIRST = pa.struct([("doc_id", pa.int64()), ("line", pa.int32())])
# Odd, scatters the places of words in a shingle.
FACTOR = np.uint64(0xD1B54A32D192ED03)


def word_hashes(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words at `starts`, `sizes` bytes long; eight bytes at a time, so one step for most words.

    Words of the same size up to eight bytes never share a hash. Words over LONG_WORD bytes are hashed one by one.
    """
    eights = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    found = sizes.astype(np.uint64) * FACTOR
    going = np.flatnonzero(sizes <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        going = going[sizes[going] > at]
        if not len(going):
            break
        unused = np.maximum(8 - (sizes[going] - at), 0).astype(np.uint64) * np.uint64(8)
        part = eights[starts[going] + at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> unused)
        found[going] = mixed(found[going] ^ part)
    for k in np.flatnonzero(sizes > LONG_WORD):
        found[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + sizes[k]])
    return found


def line_shingles(texts: list[bytes | None], least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of `least` words or more: text index, line number, digest of the words; and all their shingles with line indexes."""
    # A line end after every text, and bytes to read on over the last word.
    data = b"\n".join([*[(t or b"").lower() for t in texts], bytes(8)])
    chars = np.frombuffer(data, np.uint8)[:-8]
    solid = np.concatenate([[False], ~((chars == 32) | (chars - np.uint8(9) < 5))])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    ends = np.flatnonzero(chars == 10)
    line = np.searchsorted(ends, starts)
    n_words = np.bincount(line, minlength=len(ends))
    n_lines = np.array([(t or b"").count(b"\n") + 1 for t in texts], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), n_lines)
    number = np.arange(len(ends)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
    hashes = word_hashes(data, starts, sizes)
    first = np.cumsum(n_words) - n_words
    place = np.arange(len(line)) - first[line]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes + place.astype(np.uint64) * FACTOR))])
    digests = mixed(sums[first + n_words] - sums[first])
    enough = n_words >= least
    n = max(len(line) - SHINGLE_WORDS + 1, 0)
    found = hashes[:n].copy()
    for i in range(1, SHINGLE_WORDS):
        found *= FACTOR
        found += hashes[i : n + i]
    # A shingle lies within a line.
    inside = line[:n] == line[SHINGLE_WORDS - 1 :]
    owner = (np.cumsum(enough) - 1)[line[:n][inside]]
    return text[enough], number[enough], digests[enough].view(np.int64), mixed(found[inside]), owner


def _parts(batches: Iterator[pa.RecordBatch], n: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(at, n) for at in range(0, batch.num_rows, n))


def _list_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line's digest and place; at the end the task's token counts, with `line` below 0 as the mark."""
    counts = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    names = ["digest", "doc_id", "line"]

    def rows(digest, doc_id, line) -> pa.RecordBatch:
        arrays = [pa.array(digest, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(line, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names)

    for part in _parts(batches):
        text, number, digests, tokens, _ = line_shingles(byte_values(part.column("text")), 1)
        counts += np.bincount((tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=len(counts))
        yield rows(digests, part.column("doc_id").to_numpy()[text], number)
    used = np.flatnonzero(counts)
    yield rows(used, counts[used], np.full(len(used), -1))


def rarity_classes(counts: np.ndarray) -> np.ndarray:
    """Rarity class of every place of the count table: 0 for the rarest."""
    scaled = 4 * np.log2(np.maximum(counts, 1) / max(np.median(counts), 1))
    return np.clip(scaled + 16, 0, (1 << RARITY_BITS) - 1).astype(np.uint64)


def prefix_size(size: np.ndarray) -> np.ndarray:
    """Tokens of a set of which a similar set must share one."""
    return size - -(-SIMILARITY * size // 100) + 1


def prefixes(texts: list[bytes | None], rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`key, digest` of the rarest tokens of every line, as many as its prefix takes.

    The key holds the token, the number of tokens of the line and the token's place, so that it sorts by token; a number
    that does not fit is the largest that does, and is not filtered by.
    """
    _, _, digests, tokens, owner = line_shingles(texts)
    # Equal lines have equal rows: one of them will do.
    once = np.zeros(len(digests), dtype=bool)
    once[np.unique(digests, return_index=True)[1]] = True
    tokens, owner, digests = tokens[once[owner]], (np.cumsum(once) - 1)[owner[once[owner]]], digests[once]
    kinds = rarity[(tokens >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
    cuts = np.searchsorted(owner, np.arange(0, len(digests) + (1 << LINE_BITS), 1 << LINE_BITS))
    found = []
    for first, (low, high) in zip(range(0, len(digests), 1 << LINE_BITS), zip(cuts[:-1], cuts[1:])):
        line = (owner[low:high] - first).astype(np.uint64)
        key = (line << np.uint64(RARITY_BITS) | kinds[low:high]) << np.uint64(TOKEN_BITS)
        key = sorted_set(key | (tokens[low:high] & np.uint64((1 << TOKEN_BITS) - 1)))
        line = (key >> np.uint64(RARITY_BITS + TOKEN_BITS)).astype(np.int64)
        size = np.bincount(line)
        place = np.arange(len(key)) - np.concatenate([[0], np.cumsum(size)])[line]
        size = size[line]
        rare = place < prefix_size(size)
        token = (key[rare] & np.uint64((1 << TOKEN_BITS) - 1)).astype(np.int64)
        packed = (token - (1 << TOKEN_BITS - 1)) << 2 * SIZE_BITS
        packed |= np.minimum(size[rare], MAX_SIZE) << SIZE_BITS | np.minimum(place[rare], MAX_SIZE)
        found.append((packed, digests[first + line[rare]]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _similar_enough(a_size, a_place, b_size, b_place) -> np.ndarray:
    """Length and positional filters: whether enough tokens are left from a shared one on."""
    needed = -(-SIMILARITY * (a_size + b_size) // (100 + SIMILARITY))
    near = (100 * np.minimum(a_size, b_size) >= SIMILARITY * np.maximum(a_size, b_size)) & (
        np.minimum(a_size - a_place, b_size - b_place) >= needed
    )
    return near | (a_size == MAX_SIZE) | (b_size == MAX_SIZE)


def _pair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token and digest: pairs of lines with a common token, and the rows of long runs.

    Short runs give all their pairs. A long run gives each line with its first and, for what this leaves open, its rows.
    """
    names = ["token", "a", "b", "size", "place"]

    def out(token, a, b, size, place) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((token, a, b, size, place), types)], names)

    def pairs(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        good = _similar_enough(x[2, i], x[3, i], x[2, j], x[3, j])
        i, j = i[good], j[good]
        none = pa.nulls(len(i), pa.int32())
        return out(pa.nulls(len(i), pa.int64()), x[1, i], x[1, j], none, none)

    def long_rows(x: np.ndarray, rows: np.ndarray, hub: np.ndarray) -> pa.RecordBatch:
        return out(x[0, rows], x[1, rows], hub, x[2, rows], x[3, rows])

    rest = np.empty((4, 0), dtype=np.int64)
    hub: np.ndarray | None = None  # first row of the long run that is being read

    def finish(x: np.ndarray, hub: np.ndarray | None, last: bool) -> Iterator:
        """Handle whole runs; returns through `yield` batches, and finally what to hold."""
        if hub is not None:
            same = x[0] == hub[0]
            n = int(same.sum())
            if n:
                joined = np.column_stack([hub, x[:, :n]])
                yield pairs(joined, np.zeros(n, int), np.arange(1, n + 1))
                yield long_rows(joined, np.arange(1, n + 1), np.full(n, hub[1]))
            if n == x.shape[1] and not last:
                yield x[:, :0], hub
                return
            x, hub = x[:, n:], None
        if not x.shape[1]:
            yield x, hub
            return
        starts = np.flatnonzero(np.concatenate([[True], x[0, 1:] != x[0, :-1]]))
        lengths = np.diff(np.concatenate([starts, [x.shape[1]]]))
        held = x[:, x.shape[1] :]
        if not last:
            if lengths[-1] > SMALL_RUN:
                hub = x[:, starts[-1]].copy()
            else:
                held = x[:, starts[-1] :]
                x, starts, lengths = x[:, : starts[-1]], starts[:-1], lengths[:-1]
        of = np.repeat(lengths, lengths)
        first = np.repeat(starts, lengths)
        at = np.arange(x.shape[1])
        for step in range(1, SMALL_RUN):
            i = at[(at + step < first + of) & (of <= SMALL_RUN)]
            if not len(i):
                break
            yield pairs(x, i, i + step)
        long = at[of > SMALL_RUN]
        if len(long):
            later = long[long != first[long]]
            yield pairs(x, first[later], later)
            yield long_rows(x, long, x[1, first[long]])
        yield held, hub

    for batch in batches:
        key, digest = (batch.column(c).to_numpy() for c in ("key", "digest"))
        new = np.array([key >> 2 * SIZE_BITS, digest, key >> SIZE_BITS & MAX_SIZE, key & MAX_SIZE])
        x = np.concatenate([rest, new], axis=1)
        if not x.shape[1]:
            continue
        before = hub if hub is not None else np.full(4, -1)
        repeat = np.concatenate([[(x[0, 0] == before[0]) & (x[1, 0] == before[1])], (x[0, 1:] == x[0, :-1]) & (x[1, 1:] == x[1, :-1])])
        for found in finish(x[:, ~repeat], hub, last=False):
            if isinstance(found, tuple):
                rest, hub = found
            else:
                yield found
    for found in finish(rest, hub, last=True):
        if not isinstance(found, tuple):
            yield found


def _bits(tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each of `n` lines, tokens in the order of their lines, the parity of its tokens in each of BITS places, packed into BITS / 64 integers."""
    place = (tokens % np.uint64(BITS)).astype(np.int64)
    found = np.empty((n, BITS // 64), np.int64)
    # Some thousands of lines at a time: the counts take BITS numbers a line.
    for low in range(0, n, BITS_LINES):
        high = min(low + BITS_LINES, n)
        a, b = np.searchsorted(owner, (low, high))
        flat = np.bincount((owner[a:b] - low) * BITS + place[a:b], minlength=(high - low) * BITS) & 1
        found[low:high] = np.packbits(flat.astype(np.uint8)).view(np.int64).reshape(high - low, BITS // 64)
    return found


def _line_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full token sets of the asked lines of each text, in parts of bounded size."""
    for part in _parts(batches, 128):
        texts, places = [], []
        for text, doc_id, lines in zip(byte_values(part.column("text")), part.column("doc_id").to_pylist(), part.column("lines").to_pylist()):
            found = (text or b"").split(b"\n")
            lines = [(doc_id, x["line"], x["digest"]) for x in lines if x["line"] < len(found)]
            texts += [found[k] for _, k, _ in lines]
            places += lines
        at, _, digests, tokens, owner = line_shingles(texts)
        n = len(digests)
        # One of each token of a line, by line.
        order = np.lexsort((tokens, owner))
        tokens, owner = tokens[order], owner[order]
        new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])[: len(tokens)]
        tokens, owner = tokens[new], owner[new]
        ends = np.searchsorted(owner, np.arange(n + 1))
        first = pa.array([{"doc_id": places[k][0], "line": places[k][1]} for k in at], FIRST)
        columns = [pa.array(digests), first, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens.view(np.int64)))]
        columns += map(pa.array, _bits(tokens, owner, n).T)
        # Rows that share a doc_id each have their own lines: only the asked ones count.
        right = pa.array(digests == np.array([places[k][2] for k in at], dtype=np.int64))
        yield pa.RecordBatch.from_arrays(columns, ["digest", "first", "tokens", *BIT_NAMES]).filter(right)


def line_sets(docs: DataFrame, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """`digest, first, tokens` and parity bits of the asked lines, each read where it is first, without a shuffle of sets."""
    places = classes.join(asked, "digest").groupBy(F.col("first.doc_id").alias("doc_id"))
    wanted = cut(places.agg(F.collect_list(F.struct("first.line", "digest")).alias("lines")))
    n_wanted = wanted.agg(F.count("*") + F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(broadcast_if_small(wanted, n_wanted), "doc_id")
    bits = "".join(f", {name} long" for name in BIT_NAMES)
    return bound_batches(own).mapInArrow(_line_sets, f"digest long, first struct<doc_id: long, line: int>, tokens array<long>{bits}")


def maybe_similar(n: Column, m: Column, a: str, b: str) -> Column:
    """Whether the parity bits of two sets of `n` and `m` tokens allow the similarity; they never differ in more places than the sets."""
    apart = sum((F.bit_count(F.col(a + k).bitwiseXOR(F.col(b + k))) for k in BIT_NAMES), F.lit(0))
    return apart * (100 + SIMILARITY) <= (100 - SIMILARITY) * (n + m)


def similar(a: Column, b: Column) -> Column:
    """Whether two full token sets have a Jaccard similarity of SIMILARITY percent or more."""
    return F.size(F.array_intersect(a, b)) * (100 + SIMILARITY) >= SIMILARITY * (F.size(a) + F.size(b))


def among(known: DataFrame, digests: DataFrame) -> DataFrame:
    """The rows of `known` with one of the distinct `digests`."""
    digests = cut(digests)
    return known.join(broadcast_if_small(digests, digests.count()), "digest", "left_semi")


def later_lines(docs: DataFrame, classes: DataFrame, runs: DataFrame) -> DataFrame:
    """`digest` of every line that is similar to an earlier one: from the pairs, then from what long runs leave open."""
    pairs = cut(runs.where("token IS NULL").select("a", "b").distinct())
    long = runs.where("token IS NOT NULL AND a != b").select("token", F.col("a").alias("digest"), "size", "place")
    asked = pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).union(long.select("digest")).distinct()
    known = cut(line_sets(docs, classes, asked))
    a, b = (known.select(F.col("digest").alias(n), F.size("tokens").alias(f"{n}_size"), *[F.col(k).alias(f"{n}_{k}") for k in BIT_NAMES]) for n in "ab")
    near = maybe_similar(F.col("a_size"), F.col("b_size"), "a_", "b_")
    pairs = cut(pairs.join(a, "a").join(b, "b").where(near).select("a", "b"))
    sets = among(known, pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct())
    a, b = (sets.select(F.col("digest").alias(n), F.col("tokens").alias(f"{n}_tokens"), F.col("first").alias(f"{n}_first")) for n in "ab")
    good = pairs.join(a, "a").join(b, "b").where(similar(F.col("a_tokens"), F.col("b_tokens")) & (F.col("a_first") != F.col("b_first")))
    later = cut(good.select(F.when(F.col("a_first") > F.col("b_first"), F.col("a")).otherwise(F.col("b")).alias("digest")).distinct())
    if long.isEmpty():
        return later
    return later.union(open_lines(long, known, later))


def open_lines(long: DataFrame, known: DataFrame, later: DataFrame) -> DataFrame:
    """`digest` of the lines of long runs that are not in `later` but similar to an earlier line of their run.

    A line is asked for once: the semi join ends at the first similar line, and no pairs come out of it.
    """
    bits = known.select("digest", "first", F.size("tokens").alias("n"), *BIT_NAMES)
    left = cut(long.join(later, "digest", "left_anti").join(bits, "digest"))
    tokens = left.select("token").distinct()
    earlier = long.join(tokens, "token", "left_semi").join(bits, "digest")
    earlier = cut(earlier.select(*[F.col(c).alias(f"y_{c}") for c in earlier.columns]))
    n, m = F.col("size"), F.col("y_size")
    before = (F.col("token") == F.col("y_token")) & (F.col("y_first") < F.col("first"))
    enough = F.least(n - F.col("place"), m - F.col("y_place")) * (100 + SIMILARITY) >= SIMILARITY * (n + m)
    near = (100 * F.least(n, m) >= SIMILARITY * F.greatest(n, m)) & enough | (F.greatest(n, m) == MAX_SIZE)
    near &= before & maybe_similar(F.col("n"), F.col("y_n"), "", "y_")
    # Full sets go only to the rows whose parity bits allow a link, of either side.
    left = cut(left.join(earlier, near, "left_semi"))
    earlier = cut(earlier.join(left, near, "left_semi"))
    sets = among(known, left.select("digest").union(earlier.select("y_digest")).distinct()).select("digest", "tokens")
    x, y = left.join(sets, "digest"), earlier.join(sets.select(F.col("digest").alias("y_digest"), F.col("tokens").alias("y_tokens")), "y_digest")
    found = x.join(y, near & similar(F.col("tokens"), F.col("y_tokens")), "left_semi")
    return cut(found.select("digest").distinct())


def removed_lines(docs: DataFrame) -> DataFrame:
    """`doc_id, lines`: the numbers (from 0) of the lines of each document that repeat an earlier line.

    A line is removed if an earlier one (by doc_id, then line number) has the same words, or word shingles with a
    Jaccard similarity of 0.75 or more, whether that one is removed or not. A-Z counts as lower case. A line of fewer
    than five words is one token, all its words. Lines without words stay, and so do all lines of a document without text
    or doc_id. Rows that share a doc_id are one
    document: their equal lines of the same number do not remove each other.
    """
    own = bound_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL"))
    listed = cut(own.mapInArrow(_list_lines, "digest long, doc_id long, line int"))
    counted = listed.where("line < 0").groupBy("digest").agg(F.sum("doc_id").alias("n")).toPandas()
    counts = np.zeros(1 << COUNT_BITS, dtype=np.int64)
    counts[counted["digest"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    rarity = rarity_classes(counts)
    lines = listed.where("line >= 0")
    classes = cut(lines.groupBy("digest").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            found = prefixes(byte_values(part.column("text")), rarity)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["key", "digest"])

    rare = own.mapInArrow(emit, "key long, digest long")
    token = F.shiftright("key", 2 * SIZE_BITS)
    sorted_rows = rare.repartition(token).sortWithinPartitions("key", "digest")
    runs = cut(sorted_rows.mapInArrow(_pair_runs, "token long, a long, b long, size int, place int"))
    later = later_lines(docs, classes, runs).withColumn("removed", F.lit(True))
    judged = classes.where("n > 1").join(later, "digest", "full")
    marks = lines.join(judged.select("digest", "first", "removed"), "digest")
    gone = F.coalesce("removed", F.lit(False)) | (F.struct("doc_id", "line") != F.col("first"))
    return marks.where(gone).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The documents with all their columns, the given lines cut out of the text; n_chars follows where it is a column."""
    gone = cut(removed.select(F.col("doc_id").alias(unused(docs, "doc")), F.col("lines").alias(unused(docs, "lines"))))
    gone_doc, lines = gone.columns
    n_gone = gone.agg(F.count("*") + F.coalesce(F.sum(F.size(lines)), F.lit(0))).first()[0]
    gone = broadcast_if_small(gone, n_gone)
    joined = docs.join(gone, docs["doc_id"] == gone[gone_doc], "left")
    kept = F.filter(F.split(docs["text"], "\n", -1), lambda _, i: ~F.array_contains(F.col(lines), i))
    text = F.when(F.col(lines).isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    changed = {"text": text, "n_chars": F.when(F.col(lines).isNull(), docs["n_chars"]).otherwise(F.length(text).cast("long"))} if "n_chars" in docs.columns else {"text": text}
    return joined.select(*[changed[c].alias(c) if c in changed else docs[c] for c in docs.columns])
