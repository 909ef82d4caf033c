"""Best-fit packing: linear grouping of large lengths, few-size configurations, then best fit of small ones."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from grantlake.llm.common import byte_values, cut, running_totals
from grantlake.session import bound_batches

CAPACITY = 2048
END_ID = 0
GROUPS = 512
# Lengths up to this are small: they fill what the large ones leave.
SMALL = 256
TOKENIZER = "byte_bpe_50k.json"
# Fixed value: how the tokenizer splits text before merging.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Words(dict):
    """Packed ids by word with the space or line end before it; a bounded number of words is kept.

    None for a word that is empty or starts with white space: it cannot be encoded without what stands before it.
    """

    LIMIT = 800_000

    def __init__(self, packed: Callable[[str], bytes]) -> None:
        super().__init__()
        self.packed = packed

    def __missing__(self, word: str) -> bytes | None:
        if len(self) >= self.LIMIT:
            self.clear()
        start = word[word[:1] == "\n" :][:1]
        spaced = word if word[:1] == "\n" else " " + word
        self[word] = found = None if not start or start.isspace() else self.packed(spaced)
        return found


class Encoder:
    """The ids of a byte-level BPE vocabulary file, as little-endian 32-bit integers."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        vocabulary = described["model"]["vocab"]
        # Added tokens are found in the text first and have an id as a whole; what is between them is encoded by itself.
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in described.get("added_tokens", ())}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        # Bytes are written as printable characters: those that are printable as themselves, the others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in self.added}
        self.encode = tiktoken.Encoding("ids", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = Words(self.packed)

    def packed(self, text: str) -> bytes:
        return array("I", self.encode(text)).tobytes()

    def ids(self, text: str) -> bytes:
        if self.parts is None or not self.parts.search(text):
            return self.plain_ids(text)
        return b"".join(self.added.get(part) or self.plain_ids(part) for part in self.parts.split(text) if part)

    def plain_ids(self, text: str) -> bytes:
        """Word by word, as no token reaches over a space or line end before a word; other texts in one go."""
        first, *words = text.replace("\n", " \n").split(" ")
        try:
            return self.packed(first) + b"".join(map(self.words.__getitem__, words))
        except TypeError:
            return self.packed(text)


def pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document: whole sequences from the end, the rest first."""
    first = n % capacity or capacity
    return [(0, first), *[(at, capacity) for at in range(first, n, capacity)]]


def token_pieces(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """`doc_id, piece, start, length, ids_crc32` and, if asked, `ids`, for every piece of every document.

    A document is the ids of its text (null: none) and then id 0. Nothing is dropped; long ones are cut.
    """
    path = path or tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for part in (batch.slice(at, 256) for at in range(0, batch.num_rows, 256)):
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = (encoder.ids(text) if text else b"") + end
                    for k, (at, n) in enumerate(pieces(len(ids) // 4)):
                        own = ids[4 * at : 4 * (at + n)]
                        row = (doc_id, k, at, n, zlib.crc32(own))
                        rows.append((*row, np.frombuffer(own, "<u4").astype(np.int32)) if with_ids else row)
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                arrays = [pa.array(list(c), t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return bound_batches(docs.select("doc_id", "text")).mapInArrow(cut_up, schema)


def grouped(counts: dict[int, int], n_groups: int) -> list[tuple[int, list[list[int]]]]:
    """Lengths in falling order as groups of equal cardinality: (rounded size, [[length, count], ...])."""
    left = [[length, n] for length, n in sorted(counts.items(), reverse=True)]
    share = -(-sum(n for _, n in left) // n_groups) if left else 0
    groups = []
    while left:
        size, members, room = left[0][0], [], share
        while left and room:
            length, n = left[0]
            take = min(n, room)
            members.append([length, take])
            room -= take
            left[0][1] -= take
            if not left[0][1]:
                left.pop(0)
        groups.append((size, members))
    return groups


def fullest(sizes: list[int], left: list[int], capacity: int) -> dict[int, int]:
    """The fullest configuration with one of the largest size left: group -> how often."""
    first = next(g for g, n in enumerate(left) if n)
    room = capacity - sizes[first]
    by = np.full(room + 1, -1)
    by[0] = len(sizes)
    for g in range(first, len(sizes)):
        size = sizes[g]
        available = left[g] - (g == first)
        if size > room or not available:
            continue
        for _ in range(min(available, room // size)):
            fresh = (by[:-size] >= 0) & (by[size:] < 0)
            if not fresh.any():
                break
            by[size:][fresh] = g
        if by[room] >= 0:
            break
    at = int(np.flatnonzero(by >= 0)[-1])
    used = defaultdict(int, {first: 1})
    while at:
        g = int(by[at])
        used[g] += 1
        at -= sizes[g]
    return dict(used)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, n_groups: int = GROUPS, small: int = SMALL) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences: (lengths in it, how many such sequences). Works on the histogram of lengths alone.

    Its size depends on the capacity and the number of groups, not on the number of documents.
    """
    groups = grouped({length: n for length, n in counts.items() if length > small}, n_groups)
    sizes, left = [g for g, _ in groups], [sum(n for _, n in members) for _, members in groups]
    bins: list[tuple[tuple[int, ...], int]] = []
    while any(left):
        used = fullest(sizes, left, capacity)
        times = min(left[g] // n for g, n in used.items())
        for g, n in used.items():
            left[g] -= n * times
        runs = [_take(groups[g][1], times) for g, n in used.items() for _ in range(n)]
        bins += _overlay(runs, times)
    return best_fit(bins, {length: n for length, n in counts.items() if length <= small}, capacity)


def _take(members: list[list[int]], n: int) -> list[tuple[int, int]]:
    """`n` actual lengths of a group as runs."""
    taken = []
    while n:
        length, there = members[0]
        k = min(n, there)
        taken.append((length, k))
        n -= k
        members[0][1] -= k
        if not members[0][1]:
            members.pop(0)
    return taken


def _overlay(runs: list[list[tuple[int, int]]], times: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences of one configuration with the actual lengths in their slots, equal ones together."""
    ends = [np.cumsum([n for _, n in run]) for run in runs]
    edges = np.unique(np.concatenate(ends))
    found, before = [], 0
    for edge in edges:
        lengths = tuple(run[int(np.searchsorted(e, edge))][0] for run, e in zip(runs, ends))
        found.append((lengths, int(edge - before)))
        before = edge
    return found


def best_fit(bins: list[tuple[tuple[int, ...], int]], counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Place the small lengths, largest first, each where the least room is left that takes it."""
    by_room: dict[int, list] = defaultdict(list)
    for lengths, n in bins:
        by_room[capacity - sum(lengths)].append((lengths, n))
    rooms = sorted(by_room)

    def put(room: int, kind: tuple) -> None:
        if room not in by_room or not by_room[room]:
            if bisect_left(rooms, room) == len(rooms) or rooms[bisect_left(rooms, room)] != room:
                insort(rooms, room)
        by_room[room].append(kind)

    for length, n in sorted(counts.items(), reverse=True):
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                put(capacity, ((), -(-n // (capacity // length))))
                at = bisect_left(rooms, length)
            room = rooms[at]
            lengths, there = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
                del by_room[room]
            each = room // length
            full = min(there, n // each)
            if full:
                put(room - each * length, (lengths + (length,) * each, full))
                n -= full * each
                there -= full
            if there and n:
                put(room - n * length, (lengths + (length,) * n, 1)) if n < each else None
                there -= n < each
                n = 0 if n < each else n
            if there:
                put(room, (lengths, there))
    return [kind for room in rooms for kind in by_room[room]]


def slots(bins: list[tuple[tuple[int, ...], int]], counts: dict[int, int]) -> pd.DataFrame:
    """Where the pieces go, by their place in the order of lengths: rows `first, base, per_bin, offset, length`.

    Piece number p of that order, from `first` on, is in sequence base + (p - first) // per_bin.
    """
    order = sorted(counts)
    starts = dict(zip(order, np.concatenate([[0], np.cumsum([counts[length] for length in order])])))
    rows, base = [], 0
    for lengths, n in bins:
        offset = 0
        for length in dict.fromkeys(lengths):
            k = lengths.count(length)
            rows.append((starts[length], base, k, offset, length))
            starts[length] += k * n
            offset += k * length
        base += n
    return pd.DataFrame(rows, columns=["first", "base", "per_bin", "offset", "length"], dtype=np.int64).sort_values("first")


def pack(piece_rows: DataFrame, capacity: int = CAPACITY, n_groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """The rows (with `length` from 1 to `capacity`) and `sequence_id, offset`.

    Only the histogram of lengths (at most `capacity` rows) reaches the driver, and only the slots of kinds of
    sequences go back. Equal rows are told apart by their place alone; which of them goes where does not matter.
    """
    rows = cut(piece_rows)
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    table = slots(plan_bins(histogram, capacity, n_groups, small), histogram)
    first, base, per_bin, offset = (table[c].to_numpy() for c in ("first", "base", "per_bin", "offset"))
    order = [F.col(c) for c in ("length", "doc_id", "piece", "start", "ids_crc32")]
    placed = running_totals(rows, order, {"place": F.lit(1)})
    schema = StructType([*rows.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    names = schema.names

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, length = batch.column("place").to_numpy(), batch.column("length").to_numpy()
            at = np.searchsorted(first, place, "right") - 1
            nth = place - first[at]
            own = batch.drop_columns(["place"])
            added = [pa.array(base[at] + nth // per_bin[at]), pa.array(offset[at] + nth % per_bin[at] * length)]
            yield pa.RecordBatch.from_arrays([*own.columns, *added], names)

    return placed.select(*rows.columns, "place").mapInArrow(assign, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """`sequence_id, ids`: whole sequences of packed pieces that carry their `ids`."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
