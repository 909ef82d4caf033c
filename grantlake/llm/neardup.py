"""Near duplicates: SuperMinHash signatures, banding, verification on full shingle sets, union-find grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grantlake.llm.common import byte_values, connected_components, cut, mixed, sorted_set
from grantlake.session import bound_batches

SHINGLE_WORDS = 5
# Linked: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
# 32 bands of 4: a pair at the limit is missed by all bands with probability 5e-6.
SLOTS, BANDS = 128, 32
# Shingles a task holds at once for one side of a comparison (8 bytes each).
BLOCK_SHINGLES = 500_000
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    """64-bit hashes by word; forgotten when there are too many, so that memory stays bounded."""

    LIMIT = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def shingle_set(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, A-Z lower-cased; fewer words than a shingle are one; none: empty."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < SHINGLE_WORDS:
        return mixed(np.array([xxhash.xxh64_intdigest(values.tobytes(), seed=n)], np.uint64))
    found = values[: n - SHINGLE_WORDS + 1]
    for i in range(1, SHINGLE_WORDS):
        found = mixed(found) + values[i : n - SHINGLE_WORDS + 1 + i]
    return sorted_set(mixed(found))


def set_digest(shingles: np.ndarray) -> bytes | None:
    """Equal for equal sets; null for the empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures, one row per set; an empty set keeps `EMPTY` in every slot.

    Every element walks its own random permutation of the slots; its value at step j is j plus a fraction. A value of
    step j cannot replace one of an earlier step, so a document stops at the first step that leaves no slot empty.
    The permutation is drawn by swaps, which are traced back instead of being stored.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    signature = np.full(len(sets) * slots, EMPTY)
    if not sizes.sum():
        return signature.reshape(len(sets), slots)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    swaps: list[np.ndarray] = []
    for step in range(slots):
        drawn = mixed(element + np.uint64(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        low = drawn & np.uint64(0xFFFFFFFF)
        swap = (((low * np.uint64(slots - step)) >> np.uint64(32)).astype(np.int64) + step).astype(np.uint8)
        place = swap.copy()
        for earlier in range(step - 1, -1, -1):
            place[place == swaps[earlier]] = earlier
        value = (drawn >> np.uint64(32)) | np.uint64(step << 32)
        np.minimum.at(signature, owner * slots + place, value)
        swaps.append(swap)
        unfilled = (signature.reshape(len(sets), slots) == EMPTY).any(axis=1) & (sizes > 0)
        if not unfilled.any():
            break
        going = unfilled[owner]
        if not going.all():
            element, owner = element[going], owner[going]
            swaps = [s[going] for s in swaps]
    return signature.reshape(len(sets), slots)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of consecutive slots; keys of different bands differ."""
    rows = signature.reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), rows.shape[:2])
    for i in range(rows.shape[2]):
        key = mixed(key) + rows[:, :, i]
    return mixed(key).astype(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for part in _slices(batch, 256):
            sets = [shingle_set(t, hashes) for t in byte_values(part.column("text"))]
            keys = band_keys(super_minhash(sets))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_digest(s) for s in sets], pa.binary()),
                    pa.array([k if len(s) else None for k, s in zip(keys, sets)], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "bands"],
            )


def _slices(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, n) for at in range(0, batch.num_rows, n))


def sketches(docs: DataFrame) -> DataFrame:
    """`doc_id, n_shingles, digest, bands` for every document; a set without words has no digest and no bands."""
    schema = "doc_id long, n_shingles long, digest binary, bands array<long>"
    return bound_batches(docs.select("doc_id", "text")).mapInArrow(_sketch, schema)


def candidate_groups(classes: DataFrame) -> DataFrame:
    """`id, component`: classes connected through shared band keys. A key links each member to its smallest one."""
    banded = classes.select("id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last")
    edges = banded.join(shared.select("key", "hub"), "key").where("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    return connected_components(edges.distinct())


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets of the representatives, once for each pair of blocks that holds theirs."""
    hashes = WordHashes()
    for batch in batches:
        for part in _slices(batch, 64):
            rows = []
            columns = [part.column(c).to_pylist() for c in ("id", "digest", "component", "blocks")]
            for text, doc_id, digest, component, blocks in zip(byte_values(part.column("text")), *columns):
                found = shingle_set(text, hashes)
                if set_digest(found) != digest:
                    continue
                own = xxhash.xxh64_intdigest(digest) % blocks
                packed = found.tobytes()
                rows += [(component, min(own, o), max(own, o), own, doc_id, packed) for o in range(blocks)]
            names = ["component", "i", "j", "own", "id", "shingles"]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            values = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(values, types)], names)


def links(ids: np.ndarray, own: np.ndarray, sets: list[np.ndarray], i: int, j: int) -> list[tuple[int, int]]:
    """Verified links within one block (i == j) or between two, as a forest: one link per pair of trees joined.

    Sets are compared exactly, each with the ones of comparable size.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((ids, sizes, own if i != j else np.zeros(len(ids))))
    ids, own, sizes = ids[order], own[order], sizes[order]
    _, flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    split = int((own == i).sum()) if i != j else len(ids)
    parent = list(range(len(ids)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    found = []
    marked = np.zeros(int(flat.max()) + 1, dtype=np.uint8)
    later = sizes[split:]
    for p in range(split):
        n = sizes[p]
        if i == j:
            low, high = p + 1, int(np.searchsorted(sizes, 100 * n / SIMILARITY, "right"))
        else:
            low = split + int(np.searchsorted(later, SIMILARITY * n / 100, "left"))
            high = split + int(np.searchsorted(later, 100 * n / SIMILARITY, "right"))
        if low >= high:
            continue
        mine = flat[starts[p] : starts[p + 1]]
        marked[mine] = 1
        hits = marked[flat[starts[low] : starts[high]]]
        shared = np.add.reduceat(hits, starts[low:high] - starts[low], dtype=np.int64)
        marked[mine] = 0
        for q in low + np.flatnonzero(100 * shared >= SIMILARITY * (n + sizes[low:high] - shared)):
            a, b = root(p), root(int(q))
            if a != b:
                parent[b] = a
                found.append((int(ids[p]), int(ids[q])))
    return found


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of rows with one (component, i, j); one run is held at a time."""
    key, ids, own, sets = None, [], [], []

    def close() -> pa.RecordBatch:
        pairs = links(np.array(ids), np.array(own), sets, key[1], key[2]) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        for *at, mine, doc_id, packed in zip(*[batch.column(c).to_pylist() for c in ("component", "i", "j", "own", "id", "shingles")]):
            if at != key:
                if key:
                    yield close()
                key, ids, own, sets = at, [], [], []
            ids.append(doc_id)
            own.append(mine)
            sets.append(np.frombuffer(packed, np.uint64))
    if key:
        yield close()


def verified_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """`a, b`: links between class representatives that connect all they link, checked on full sets.

    Candidate groups are taken apart into hashed blocks of bounded size, and every pair of blocks is one unit of work.
    """
    known = groups.join(classes.select("id", "digest", "n_shingles"), "id")
    blocks = F.ceil(F.sum("n_shingles") / block).cast("int")
    members = known.join(known.groupBy("component").agg(blocks.alias("blocks")), "component")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(members.drop("n_shingles"), "id")
    rows = bound_batches(texts).mapInArrow(
        _block_rows, "component long, i int, j int, own int, id long, shingles binary"
    )
    key = ["component", "i", "j"]
    return rows.repartition(*key).sortWithinPartitions(*key, "id").mapInArrow(_link_rows, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """`doc_id, n_shingles, component_id, kept` for every row of `docs`.

    component_id is the smallest doc_id connected by links; kept marks it. Equal sets are one class, linked without
    comparison. A text without words (or null) is linked with nothing. Rows that share a doc_id count as one document
    and are all marked alike. A document without an id has its class's component, or null, and is kept only if null.
    """
    rows = cut(sketches(docs))
    distinct = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
    classes = cut(distinct.agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")))
    found = connected_components(cut(verified_links(docs, classes, candidate_groups(classes))))
    component = F.coalesce("component", "id").alias("component_id")
    labelled = classes.select("digest", "id").join(found, "id", "left").select("digest", component)
    joined = rows.select("doc_id", "n_shingles", "digest").join(labelled, "digest", "left")
    result = joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all their columns; of rows with one id and set, one stays."""
    marks = cut(near_duplicates(docs))
    dropped = marks.where("NOT kept").select("doc_id").distinct()
    left = docs.join(dropped, "doc_id", "left_anti")
    repeated = marks.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    once = left.join(repeated, "doc_id").dropDuplicates(["doc_id"])
    return left.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
