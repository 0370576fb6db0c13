"""Seekable Zstandard bundles of WARC records.

A bundle is a file of independent Zstandard frames, each with some whole WARC
records, followed by a seek table in a skippable frame (the public seekable
format, with a checksum for each frame). The index has, for each record, its
bundle, its frame and its offset in the unpacked frame, so that one record
costs the reading of one frame.

Tasks write bundles under a temporary name and rename them when whole; the
index, a table that Spark commits, names only those. A task that is lost and
run again leaves a file that nothing refers to. The folder must be one that
pyarrow's file systems reach from every node (file, hdfs, s3, gs).

Results in odd cases: a null payload is an empty one. Payloads under `least`
bytes are always responses. A null id takes no part in the choice of a
response and always is one; of repeated rows with the smallest id all are
responses. A null address leaves the record's header out; control characters
and spaces in one are percent-encoded. An empty table gives an empty index and no
bundle. A record larger than a frame gets a frame of its own.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.columns import set_aside
from plumbline.llm.scratch import Scratch

#: Bytes of records in a frame, and of frames in a bundle, after which a new one begins.
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26

# Fixed values of the seekable format: a skippable frame's magic number, the footer's, the footer's flag for checksums.
SKIPPABLE = 0x184D2A5E
FOOTER = 0x8F92EAB1
CHECKSUMS = 0x80
# Fixed value of WARC 1.1: the profile of revisits with an equal payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, record_type string, bundle string, frame int, offset long, length long"
FRAMES = "bundle string, frame int, start long, packed long, raw long, checksum long"
RECORDS = "record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def decided(pages: DataFrame, scratch: Scratch, id: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """Columns id, url, payload, digest, size and refers_to (the id whose payload is equal; null for a response).

    Only digests and ids are grouped. The groups of two and more are a written
    table, so that its size decides how it is joined, and a payload that very
    many pages share is split over tasks by Spark's handling of skewed joins.
    """
    plain, names, _ = set_aside(pages)
    payload = F.coalesce(F.col(names[html]).cast("binary"), F.lit(b""))
    rows = plain.select(F.col(names[id]).alias("id"), F.col(names[url]).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    shared = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    first = scratch.keep(shared.select(F.col("digest").alias("shared"), "first"), "shared-payloads")
    return rows.join(first, F.col("digest") == F.col("shared"), "left").select("id", "url", "payload", "digest", "size", F.when(F.col("id") > F.col("first"), F.col("first")).alias("refers_to"))


def write_bundles(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", name: str = "urn:page:", frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3) -> DataFrame:
    """Write a record for each of the rows that `decided` gives; the index of records, which does the writing when it is evaluated (evaluate it once, and keep it)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("id", "url", "payload", "digest", "size", "refers_to")}
                if bundle is None:
                    bundle = _Bundle(folder, frame_bytes, level)
                bundle.add(f"{name}{row['id']}", "response" if row["refers_to"] is None else "revisit", _record(row, name, date))
                if bundle.size >= bundle_bytes:
                    yield bundle.close()
                    bundle = None
        if bundle is not None:
            yield bundle.close()

    return rows.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", "size", F.col("refers_to").cast("string").alias("refers_to")).mapInArrow(write, INDEX)


def _record(row: dict, name: str, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    response = row["refers_to"] is None
    block = http + row["payload"] if response else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <{name}{row['id']}>", f"WARC-Date: {date}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]))
    if not response:
        head += [f"WARC-Refers-To: <{name}{row['refers_to']}>", f"WARC-Profile: {SAME_PAYLOAD}"]
    head += [f"WARC-Payload-Digest: sha256:{row['digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Bundle:
    """A bundle that is being written by one task."""

    def __init__(self, folder: str, frame_bytes: int, level: int):
        self.fs, at = files.FileSystem.from_uri(folder)
        self.fs.create_dir(at, recursive=True)
        stem = uuid.uuid4().hex
        self.uri, self.path, self.part = f"{folder}/{stem}.warc.zst", f"{at}/{stem}.warc.zst", f"{at}/{stem}.part"
        self.out = self.fs.open_output_stream(self.part, compression=None)
        self.packer, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.frames: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.raw = self.size = 0
        self.rows: list[tuple] = []

    def add(self, record_id: str, kind: str, record: bytes) -> None:
        if self.held and self.raw + len(record) > self.frame_bytes:
            self.end_frame()
        self.rows.append((record_id, kind, self.uri, len(self.frames), self.raw, len(record)))
        self.held.append(record)
        self.raw += len(record)

    def end_frame(self) -> None:
        data = b"".join(self.held)
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.held, self.raw, self.size = [], 0, self.size + len(packed)

    def close(self) -> pa.RecordBatch:
        """The records' index, once the bundle is whole under its name."""
        if self.held:
            self.end_frame()
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.part, self.path)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), _types(INDEX), strict=True)], names=_names(INDEX))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _types(schema: str) -> list[pa.DataType]:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return [kinds[c.split()[1]] for c in schema.split(", ")]


def seek_table(file: pa.NativeFile) -> list[tuple[int, int, int, int]]:
    """Start, packed size, size and checksum (-1: none) of each frame of a seekable file."""
    end = file.size()
    file.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    width = 12 if flags & CHECKSUMS else 8
    if magic != FOOTER:
        raise ValueError("no seek table at the file's end")
    file.seek(end - 9 - count * width - 8)
    kind, size = struct.unpack("<II", file.read(8))
    if kind != SKIPPABLE or size != count * width + 9:
        raise ValueError("the seek table's frame doesn't fit its footer")
    table, start, out = file.read(count * width), 0, []
    for i in range(count):
        packed, raw, *check = struct.unpack_from("<III" if width == 12 else "<II", table, i * width)
        out.append((start, packed, raw, check[0] if check else -1))
        start += packed
    return out


def _unpacked(file: pa.NativeFile, frame: tuple[int, int, int, int]) -> bytes:
    start, packed, raw, checksum = frame
    file.seek(start)
    data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=raw)
    if len(data) != raw or checksum >= 0 and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
        raise ValueError("a frame isn't what its seek table says")
    return data


def _file(uri: str) -> pa.NativeFile:
    fs, path = files.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def _parsed(data: bytes, at: int, payload: bool) -> tuple[tuple, int]:
    """The record at that offset as a row of RECORDS, and where the next one begins. A response's digest is worked out from what was read."""
    body = data.index(b"\r\n\r\n", at) + 4
    first, *lines = data[at : body - 4].decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("no record begins here")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    end = body + int(head["content-length"])
    inner = data.index(b"\r\n\r\n", body) + 4
    length = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", data[body:inner])[1])
    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
    held = data[inner:end]
    if kind == "response" and (len(held) != length or hashlib.sha256(held).hexdigest() != digest):
        raise ValueError(f"{head['warc-record-id']}: the payload isn't what its digest says")
    refers = head.get("warc-refers-to")
    row = (head["warc-record-id"].strip("<>"), kind, head.get("warc-target-uri"), refers and refers.strip("<>"), digest, length, held if payload and kind == "response" else None)
    return row, end + 4


def _batches(rows: Iterator[tuple], schema: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _types(schema), strict=True)], names=_names(schema))
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x) for x in row if isinstance(x, bytes | str))
        if size >= most:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def frames(bundles: DataFrame) -> DataFrame:
    """The frames (FRAMES) of bundles, a column `bundle`: only the seek tables are read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    with _file(uri) as file:
                        for i, frame in enumerate(seek_table(file)):
                            yield (uri, i, *frame)

        yield from _batches(rows(), FRAMES)

    return bundles.select("bundle").mapInArrow(read, FRAMES)


def read_bundles(bundles: DataFrame, payload: bool = True, tasks: int | None = None) -> DataFrame:
    """All records (RECORDS) of the bundles, a frame at a time: frames, not bundles, are dealt to tasks. Without payload that column is null, but digests are still worked out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            file, opened = None, None
            for batch in batches:
                for uri, _, *frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if uri != opened:
                        file, opened = _file(uri), uri
                    data, at = _unpacked(file, tuple(frame)), 0
                    while at < len(data):
                        row, at = _parsed(data, at, payload)
                        yield row

        yield from _batches(rows(), RECORDS)

    found = frames(bundles)
    spread = found.repartition(tasks, "bundle", "frame") if tasks else found.repartition("bundle", "frame")
    return spread.mapInArrow(read, RECORDS)


def fetch(index: DataFrame, record_ids: DataFrame, payload: bool = True) -> DataFrame:
    """The records (RECORDS) of a table of record_id, by index and seek table: only frames that hold one of them are read, each once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            file, table, opened, unpacked, data = None, [], None, None, b""
            for batch in batches:
                for uri, frame, offset in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset")), strict=True):
                    if uri != opened:
                        file, opened, unpacked = _file(uri), uri, None
                        table = seek_table(file)
                    if frame != unpacked:
                        data, unpacked = _unpacked(file, table[frame]), frame
                    yield _parsed(data, offset, payload)[0]

        yield from _batches(rows(), RECORDS)

    order = ["bundle", "frame", "offset"]
    asked = index.join(record_ids.select("record_id").distinct(), "record_id").select(*order)
    return asked.repartition("bundle", "frame").sortWithinPartitions(*order).mapInArrow(read, RECORDS)


def archived(spark: SparkSession, pages: DataFrame, name: str = "urn:page:", least: int = 100) -> DataFrame:
    """Write the pages to bundles in the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, as the archives have them."""
    scratch = Scratch(spark, "warc")
    index = scratch.keep(write_bundles(decided(pages, scratch, least=least), f"{scratch.at}/bundles", name=name), "index")
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(name) + 1}) as bigint)")
    records = read_bundles(index.select("bundle").distinct(), payload=False)
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "url")
