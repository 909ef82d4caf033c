"""WARC archives with a two-level capture index: sorted keys in compressed blocks, and a sparse directory of the blocks."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantlake.llm.common import filed, new_folder
from grantlake.session import bound_batches

# Index lines in one compressed block.
BLOCK_LINES = 1000
# Bytes after which a writing task starts a new archive file.
FILE_BYTES = 256 * 1024 * 1024
# Archive bytes that one reading task is meant for, and the most tasks of a read.
READ_BYTES, MOST_READERS = 16 * 1024 * 1024, 200_000
DATE = "1970-01-01T00:00:00Z"
INDEX_SCHEMA = "key string, page_id long, file string, offset long, length long"
# The smallest payload that may be replaced by a reference to an equal one.
LEAST_BYTES = 0


def reversed_key(url: str | None) -> str:
    """Host labels from the top, then path and query: `https://a.b.org/x?y` -> `org,b,a)/x?y`."""
    rest = (url or "").split("://", 1)[-1].split("#", 1)[0]
    at = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, tail = rest[:at].lower().rsplit("@", 1)[-1], rest[at:]
    return ",".join(reversed(host.split("."))) + ")" + (tail or "/")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record(row: dict) -> bytes:
    """One WARC record as a gzip member of its own. A revisit has no payload, but says how long it is."""
    payload = (row["html"] or "").encode()
    response = row["refers_to"] is None
    head = {
        "WARC-Type": "response" if response else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '%s %s' % (row['page_id'], row['url']))}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": json.dumps(row["url"] or "")[1:-1],
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Payload-Length": len(payload),
        "WARC-Page-ID": "" if row["page_id"] is None else row["page_id"],
    }
    if not response:
        head["WARC-Refers-To-Page-ID"] = row["refers_to"]
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload * response
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": len(body)}
    lines = "".join(f"{name}: {value}\r\n" for name, value in head.items())
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n", 4, mtime=0)


def parse(packed: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and payload of one record; lengths and digest are checked."""
    data = gzip.decompress(packed)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(headers["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    if version != "WARC/1.1" or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    if headers["WARC-Type"] == "response" and f"sha1:{digest(payload)}" != headers["WARC-Payload-Digest"]:
        raise ValueError("payload and digest differ")
    return headers, payload


def with_references(pages: DataFrame) -> DataFrame:
    """`page_id, url, html, refers_to`: the largest page_id with an equal payload for all but that one."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload.cast("binary")).alias("sha"))
    last = rows.groupBy("sha").agg(F.max("page_id").alias("last"))
    small = F.octet_length(F.coalesce("html", F.lit(""))) < LEAST_BYTES
    refers = F.when(~small & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return rows.join(last, "sha").select("page_id", "url", "html", refers.alias("refers_to"))


def write_records(pages: DataFrame, folder: str) -> DataFrame:
    """Index rows of the records written: one archive file per task, named anew, so that a repeated task harms nothing."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                for row in part.to_pylist():
                    if out is None or at >= FILE_BYTES:
                        if out:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    packed = record(row)
                    out.write(packed)
                    rows.append((reversed_key(row["url"]), row["page_id"], name, at, len(packed)))
                    at += len(packed)
            if rows:
                yield _index_batch(rows)
        if out:
            out.close()

    return bound_batches(with_references(pages)).mapInArrow(write, INDEX_SCHEMA)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["key", "page_id", "file", "offset", "length"])


def write_index(entries: DataFrame, folder: str) -> list[tuple[str, str, str]]:
    """Write the index in ranges of keys; return (first key, last key, name) of each range, one per task."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        name, directory, lines, at, out = uuid.uuid4().hex, [], [], 0, None

        def close_block() -> None:
            nonlocal at
            packed = gzip.compress("\n".join(json.dumps(line) for line in lines).encode(), 6, mtime=0)
            out.write(packed)
            directory.append((lines[0][0], lines[-1][0], at, len(packed)))
            at += len(packed)
            lines.clear()

        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                out = out or system.open_output_stream(f"{root}/{name}.index", compression=None)
                lines.append(row)
                if len(lines) == BLOCK_LINES:
                    close_block()
        if out is None:
            return
        if lines:
            close_block()
        out.close()
        with system.open_output_stream(f"{root}/{name}.blocks", compression=None) as file:
            file.write(json.dumps(directory).encode())
        yield pa.RecordBatch.from_pydict({"first": [directory[0][0]], "last": [directory[-1][1]], "name": [name]})

    # By whole entries, so that the captures of one URL may fill many ranges.
    order = ("key", "page_id", "file", "offset")
    ordered = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = ordered.mapInArrow(write, "first string, last string, name string").collect()
    return sorted((p["first"], p["last"], p["name"]) for p in parts)


class Index:
    """Looks keys up in the ranges of an index: the directory of a range, then its blocks. The last of each is kept."""

    def __init__(self, folder: str, ranges: list[tuple[str, str, str]]) -> None:
        self.system, self.root = _filesystem(folder)
        self.ranges, self.lasts = ranges, [last for _, last, _ in ranges]
        self.directory: tuple[str, list, list] = ("", [], [])
        self.block: tuple[tuple, list, list] = ((), [], [])

    def ranges_of(self, key: str) -> Iterator[str]:
        """The names of the ranges that can hold a key; the captures of one URL may fill several."""
        for first, _, name in self.ranges[bisect_left(self.lasts, key) :]:
            if first > key:
                break
            yield name

    def lookup(self, key: str, name: str) -> Iterator[list[list]]:
        """The entries of a key in a range, block by block: [key, page_id, file, offset, length]."""
        if self.directory[0] != name:
            with self.system.open_input_stream(f"{self.root}/{name}.blocks", compression=None) as file:
                blocks = json.loads(file.read())
            self.directory = (name, blocks, [b[1] for b in blocks])
        _, blocks, lasts = self.directory
        for start, _, at, length in blocks[bisect_left(lasts, key) :]:
            if start > key:
                break
            if self.block[0] != (name, at):
                with self.system.open_input_file(f"{self.root}/{name}.index") as file:
                    file.seek(at)
                    lines = [json.loads(line) for line in gzip.decompress(file.read(length)).split(b"\n")]
                self.block = ((name, at), lines, [line[0] for line in lines])
            _, lines, keys = self.block
            yield lines[bisect_left(keys, key) : bisect_right(keys, key)]


class Archive:
    """Archives in a shared folder and their index."""

    def __init__(self, spark: SparkSession, folder: str, ranges: list[tuple[str, str, str]]) -> None:
        self.spark, self.folder, self.ranges = spark, folder, ranges

    @classmethod
    def write(cls, pages: DataFrame, folder: str | None = None) -> Archive:
        """Write every page as a record. Null html is empty; null urls have the key of the empty one.

        Pages with equal payloads refer to the largest page_id among them; rows that repeat that one are responses too.
        """
        spark = pages.sparkSession
        folder = folder or new_folder(spark, "warc")
        entries = f"{folder}/entries"
        write_records(pages, f"{folder}/records").write.parquet(entries)
        return cls(spark, folder, write_index(spark.read.parquet(entries), f"{folder}/index"))

    def entries(self, keys: DataFrame) -> DataFrame:
        """`key, page_id, file, offset, length`: the index entries of the distinct `key`s.

        A key is asked of each range that can hold it, and ranges are dealt to tasks, so that one URL with very many captures is
        looked up by many. Within a task keys are sorted, so it walks through neighbouring blocks.
        """
        folder, ranges = f"{self.folder}/index", self.ranges

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(folder, ranges)
            for batch in batches:
                found = [(key, name) for key in batch.column("key").to_pylist() if key is not None for name in index.ranges_of(key)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*found)], ["key", "range"])

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(folder, ranges)
            for batch in batches:
                for key, name in zip(batch.column("key").to_pylist(), batch.column("range").to_pylist()):
                    yield from (_index_batch(rows) for rows in index.lookup(key, name) if rows)

        placed = keys.select("key").distinct().mapInArrow(place, "key string, range string")
        dealt = placed.repartition(max(1, min(len(ranges), MOST_READERS)), "range").sortWithinPartitions("range", "key")
        return dealt.mapInArrow(look, INDEX_SCHEMA)

    def read(self, keys: DataFrame) -> DataFrame:
        """`key, page_id, payload, payload_bytes, payload_digest, record_type, refers_to` of all captures of the distinct `key`s.

        Entries are dealt to tasks by the bytes of their records, in the order of the archives, where they are read by range.
        """
        folder = self.folder

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            system, root = _filesystem(f"{folder}/records")
            files: dict[str, fs.NativeFile] = {}
            for batch in batches:
                rows: list[tuple] = []
                size = 0
                for key, page_id, name, offset, length in zip(*[column.to_pylist() for column in batch.columns]):
                    if name not in files:
                        if len(files) >= 64:
                            files.pop(next(iter(files))).close()
                        files[name] = system.open_input_file(f"{root}/{name}")
                    files[name].seek(offset)
                    headers, payload = parse(files[name].read(length))
                    refers = headers.get("WARC-Refers-To-Page-ID")
                    rows.append((
                        key, page_id, payload if refers is None else None, int(headers["WARC-Payload-Length"]),
                        headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"], refers and int(refers),
                    ))
                    size += len(payload)
                    if size > 4_000_000 or len(rows) >= 1000:
                        yield _record_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _record_batch(rows)

        found = filed(self.entries(keys), "entries")
        n_bytes = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        n_parts = max(1, min(-(-n_bytes // READ_BYTES), MOST_READERS))
        asked = found.repartitionByRange(n_parts, "file", "offset").sortWithinPartitions("file", "offset")
        schema = "key string, page_id long, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
        return asked.mapInArrow(read, schema)

    def keys(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/entries").select("key")


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["key", "page_id", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)
