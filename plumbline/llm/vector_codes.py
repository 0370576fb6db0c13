"""Compression of vectors to short codes by exact integer codebooks, one for each part of the vector.

Components become integers (floor of `scale` times the component), so that
distances, sums and means are exact and the result is the same whatever the
tasks are. A round sends the codebooks, whose size doesn't depend on the
table's, to all tasks; each works out all distances of its batches by norm
expansion and int64 products and sums its vectors by nearest entry; the sums
meet in a shuffle of at most parts x entries rows a task.

Results in odd cases: a vector that is null, empty or holds null or non-finite
components takes no part, nor does one of another length than the kept vector
with the smallest id. A length that the parts don't divide is filled up with
zeros. Fewer kept vectors than entries give smaller codebooks. Null ids come
last; equal ids are ordered by their vectors. Repeated rows count as often as
they occur. Integers beyond LARGEST are held at it, so that no sum overflows.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.columns import set_aside
from plumbline.llm.scratch import Scratch

#: Integer components are held between -LARGEST - 1 and LARGEST: a distance over 1024 components still fits in 62 bits.
LARGEST = (1 << 25) - 1

#: Vectors whose distances are worked out at a time.
ROWS = 4096

SUMS = "part int, entry int, at int, total long, n long"


def kept(vectors: DataFrame, id: str, embedding: str, label: str) -> DataFrame:
    """Columns id, label and embedding (doubles) of the rows that take part, whatever their length."""
    plain, names, _ = set_aside(vectors)
    rows = plain.select(F.col(names[id]).alias("id"), F.col(names[label]).alias("label"), F.col(names[embedding]).cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0))


def integers(values: np.ndarray, length: int, parts: int, scale: int) -> np.ndarray:
    """Vectors, one after the other, as int64 of the shape (vectors, parts, width)."""
    width = -(-length // parts)
    out = np.zeros((len(values) // length, parts * width), dtype=np.int64)
    out[:, :length] = np.clip(np.floor(values.reshape(-1, length) * float(scale)), -LARGEST - 1, LARGEST)
    return out.reshape(-1, parts, width)


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry (the first of equal ones) of every part, and its squared distance: arrays of the shape (vectors, parts)."""
    chosen = np.empty(x.shape[:2], dtype=np.int64)
    distance = np.empty(x.shape[:2], dtype=np.int64)
    for p in range(x.shape[1]):
        part, book = x[:, p], books[p]
        found = (book * book).sum(axis=1)[None, :] - 2 * (part @ book.T)
        chosen[:, p] = found.argmin(axis=1)
        distance[:, p] = np.take_along_axis(found, chosen[:, p : p + 1], axis=1)[:, 0] + (part * part).sum(axis=1)
    return chosen, distance


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            some = batch.slice(i, ROWS)
            yield some, some.column("embedding").flatten().to_numpy(zero_copy_only=False)


def first_books(rows: DataFrame, parts: int, entries: int, scale: int) -> tuple[np.ndarray, int] | None:
    """The first codebooks and the vectors' length; `entries` rows come to the driver."""
    order = [F.col("id").asc_nulls_last(), F.col("embedding")]
    found = rows.orderBy(*order).limit(1).collect()
    if not found:
        return None
    length = len(found[0]["embedding"])
    some = rows.where(F.size("embedding") == length).orderBy(*order).limit(entries).collect()
    x = integers(np.array([r["embedding"] for r in some], dtype=np.float64).ravel(), length, parts, scale)
    return np.ascontiguousarray(x.transpose(1, 0, 2)), length


def better_books(rows: DataFrame, books: np.ndarray, length: int, scale: int) -> np.ndarray:
    """Each entry replaced by the componentwise floor of the mean of the parts it is nearest to; an entry without any stays."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(books.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for _, values in _runs(batches):
            x = integers(values, length, parts, scale)
            chosen, _ = assigned(x, books)
            for p in range(parts):
                np.add.at(totals[p], chosen[:, p], x[:, p])
                counts[p] += np.bincount(chosen[:, p], minlength=entries)
        part, entry = np.nonzero(counts)
        if len(part):
            columns = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), totals[part, entry].ravel(), np.repeat(counts[part, entry], width)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [pa.int64()] * 2, strict=True)], names=["part", "entry", "at", "total", "n"])

    merged = rows.select("embedding").mapInArrow(sums, SUMS).groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    new = books.copy()
    for part, entry, at, total, n in merged.collect():  # parts x entries x width rows at most, whatever the table's size
        new[part, entry, at] = total // n
    return new


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(rows: DataFrame, books: np.ndarray, length: int, scale: int) -> DataFrame:
    """id, label, code (two hex digits a part) and error of every row."""
    parts = books.shape[0]
    digits = np.array([f"{i:02x}" for i in range(256)])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, values in _runs(batches):
            chosen, distance = assigned(integers(values, length, parts, scale), books)
            codes = ["".join(row) for row in digits[chosen]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(distance.sum(axis=1))], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(code, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(spark: SparkSession, vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """The caller's id and label, code, error, label_error (the sum over rows of the same label, nulls together) and codebooks_sha256 of every vector that takes part."""
    if entries > 256:
        raise ValueError("a code has two hex digits a part: at most 256 entries")
    rows = kept(vectors, id, embedding, label)
    if (found := first_books(rows, parts, entries, scale)) is None:
        out = rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return _named(out, id, label, F.lit(""))
    books, length = found
    rows = rows.where(F.size("embedding") == length)
    for _ in range(rounds):
        books = better_books(rows, books, length, scale)
    scratch = Scratch(spark, "vector-codes")
    codes = scratch.keep(coded(rows, books, length, scale), "codes")
    totals = scratch.keep(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    out = codes.join(totals, F.col("label").eqNullSafe(F.col("of")), "left").select("id", "label", "code", "error", "label_error")
    return _named(out, id, label, F.lit(digest(books)))


def _named(out: DataFrame, id: str, label: str, sha: Column) -> DataFrame:
    return out.select("id", "code", "error", "label_error", sha.alias("codebooks_sha256"), "label").toDF(id, "code", "error", "label_error", "codebooks_sha256", label)
