"""Token sequences from whole documents: best-fit-decreasing bins, and order-preserving windows."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tokens import default_path, encoder
from plumbline.llm.words import slices

#: Tokens that are packed together; memory grows with this, padding shrinks with it.
BLOCK_TOKENS = 1_000_000
#: What a cut costs, in tokens of padding, at a sentence's end and anywhere else; at a document's end it costs nothing.
SENTENCE_CUT, HARD_CUT = 4, 32
#: Where no sentence ends for so many tokens, a window may be cut every so often.
STRETCH = 64


def blocks(batches: Iterator[pa.RecordBatch], path: str, end: int | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, their null mask, token ids, n + 1 offsets) of runs of documents with `most` tokens or little more."""
    code, held, size = encoder(path), [], 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.concatenate([np.diff(o) for _, _, o in held])
        docs = pa.concat_arrays([d for d, _, _ in held])
        null = docs.is_null().to_numpy(zero_copy_only=False)
        return docs.fill_null(0).to_numpy(zero_copy_only=False), null, np.concatenate([i for _, i, _ in held]), np.concatenate([[0], np.cumsum(lengths)])

    for batch in batches:
        for part in slices(batch, "text"):
            ids, offsets = code.encode(part.column("text"), end)
            held.append((part.column("id"), ids, offsets))
            size += len(ids)
            if size >= most:
                yield joined()
                held, size = [], 0
    if held:
        yield joined()


class CapacityTree:
    """Open bins by free room, in a segment tree: the bin with the least room that still fits is found in log(room) steps."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def push(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        self._add(room, 1)

    def pop(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room of `need` or more, with that room; it is taken out."""
        at = need + self.leaves
        while not self.count[at]:
            while at & 1:  # a right child: nothing to the right below this parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at *= 2
            if not self.count[at]:
                at += 1
        room = at - self.leaves
        self._add(room, -1)
        return self.bins[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, most: int) -> np.ndarray:
    """The bin of each length (none is over `most`): longest first, each into the fullest bin that it fits."""
    tree, out, made = CapacityTree(most), np.zeros(len(lengths), dtype=np.int64), 0
    for at in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[at])
        found = tree.pop(need)
        if found is None:
            found, made = (made, most), made + 1
        out[at] = found[0]
        if found[1] > need:
            tree.push(found[1] - need, found[0])
    return out


def pieces_of(offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents cut losslessly into pieces of `most` tokens and a rest: document number, start and length of each piece."""
    sizes = np.diff(offsets)
    n = -(-sizes // most)
    doc = np.repeat(np.arange(len(sizes)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * most
    return doc, start, np.minimum(most, sizes[doc] - start)


def _bins(path: str, end: int | None, most: int, pad: int, block_tokens: int) -> Callable:
    def lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType, null: np.ndarray | None = None) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind, mask=null))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for docs, null, ids, offsets in blocks(batches, path, end, block_tokens):
            doc, start, length = pieces_of(offsets, most)
            bin_of = best_fit_decreasing(length, most)
            order = np.argsort(bin_of, kind="stable")
            doc, start, length, bin_of = doc[order], start[order], length[order], bin_of[order]
            n = int(bin_of[-1]) + 1 if len(bin_of) else 0
            first = np.searchsorted(bin_of, np.arange(n + 1))
            for a in range(0, n, 256):  # rows of a matrix, 256 at a time
                z = min(n, a + 256)
                i, j = first[a], first[z]
                size = length[i:j]
                room = np.cumsum(size) - size
                place = room - room[first[a:z] - i].repeat(np.diff(first[a : z + 1])) + (bin_of[i:j] - a) * most
                at = np.repeat(place - room, size) + np.arange(size.sum())
                matrix, position = np.full((z - a) * most, pad, np.int32), np.zeros((z - a) * most, np.int32)
                inside = np.arange(size.sum()) - np.repeat(room, size)
                matrix[at] = ids[np.repeat(offsets[doc[i:j]] + start[i:j], size) + inside]
                position[at] = inside
                used = np.add.reduceat(size, first[a:z] - i)
                bounds = np.concatenate([np.concatenate([[0], np.cumsum(size[first[b] - i : first[b + 1] - i])]) for b in range(a, z)])
                rows = np.arange(z - a + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(base + np.arange(a, z)),
                        pa.array(used),
                        lists(matrix, rows * most, pa.int32()),
                        lists(position, rows * most, pa.int32()),
                        lists(bounds, first[a : z + 1] - i + rows, pa.int32()),
                        lists(docs[doc[i:j]], first[a : z + 1] - i, pa.int64(), null[doc[i:j]]),
                        lists(start[i:j], first[a : z + 1] - i, pa.int64()),
                    ],
                    names=["sequence_id", "n_tokens", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "starts"],
                )
            base += n

    return run


def pack_best_fit(docs: DataFrame, most: int = 4096, pad: int = 0, end: int | None = 2, path: str | None = None, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packed id matrices: a row for each sequence of `most` ids.

    sequence_id; n_tokens (without padding); input_ids (padded with `pad` to
    `most`); position_ids (from 0 in each segment, 0 in the padding);
    cu_seqlens (cumulative segment lengths, from 0); doc_ids and starts (each
    segment's document and its place among that document's ids).

    Documents of more than `most` ids are cut into pieces of `most` and a rest;
    no id is lost. Each run of about `block_tokens` tokens of an input partition
    is packed by itself, longest pieces first, each into the fullest sequence
    with room, so nothing is shuffled and memory is bounded by the run (or by
    one document that is longer).

    Null and empty texts have the id `end` only, or without `end` no segment. A
    null id gives null in doc_ids; repeated rows are packed each; an empty table
    gives no rows; other columns of docs play no part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "sequence_id long, n_tokens long, input_ids array<int>, position_ids array<int>, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"
    return rows.mapInArrow(_bins(path or default_path(), end, most, pad, block_tokens), schema)


def cut_windows(points: np.ndarray, costs: np.ndarray, most: int) -> list[int]:
    """Cuts (some of the points, with the first and last) whose windows have `most` tokens or fewer, at the least padding plus costs.

    A window is padded to `most` unless its length is a power of two. With
    f(j) the least cost up to point j, a padded window from i costs
    f(i) + most - (p_j - p_i): the best i among those in reach is the head of a
    queue of f(i) + p_i that only rises. Windows of a power of two are looked
    up by their length. Neighbouring points must lie within `most`.
    """
    at, cost = points.tolist(), costs.tolist()
    powers = [1 << k for k in range(most.bit_length()) if 1 << k < most]
    place: dict[int, int] = {at[0]: 0}
    best, came = [0.0] * len(at), [0] * len(at)
    queue: deque[tuple[float, int]] = deque([(float(at[0]), 0)])
    for j in range(1, len(at)):
        p = at[j]
        while at[queue[0][1]] < p - most:
            queue.popleft()
        low, i = queue[0]
        value, source = low + most - p, i
        for power in powers:
            k = place.get(p - power)
            if k is not None and best[k] < value:
                value, source = best[k], k
        value += cost[j]
        best[j], came[j], place[p] = value, source, j
        rising = value + p
        while queue and queue[-1][0] >= rising:
            queue.pop()
        queue.append((rising, j))
    cuts = [len(at) - 1]
    while cuts[-1]:
        cuts.append(came[cuts[-1]])
    return [at[j] for j in reversed(cuts)]


def cut_points(offsets: np.ndarray, ends: np.ndarray, most: int, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may be cut, and what each cut costs: documents' ends, sentences' ends, and steps of `stretch` where neither comes for longer."""
    total = int(offsets[-1])
    cost = np.full(total + 1, -1.0)
    cost[np.flatnonzero(ends) + 1] = SENTENCE_CUT
    cost[offsets] = 0
    cost[[0, total]] = 0
    points = np.flatnonzero(cost >= 0)
    gaps = np.diff(points)
    wide = np.flatnonzero(gaps > stretch)
    extra = [np.arange(points[w] + stretch, points[w + 1], stretch) for w in wide.tolist()]
    if extra:
        hard = np.concatenate(extra)
        cost[hard] = HARD_CUT
        points = np.flatnonzero(cost >= 0)
    return points, cost[points]


def split_tail(cuts: list[int], most: int) -> list[int]:
    """Cut the last window into powers of two where that costs less than its padding."""
    if len(cuts) < 2:
        return cuts
    size = cuts[-1] - cuts[-2]
    parts = [1 << k for k in reversed(range(size.bit_length())) if size >> k & 1]
    if size < most and len(parts) > 1 and (len(parts) - 1) * HARD_CUT < most - size:
        return [*cuts[:-1], *(cuts[-2] + np.cumsum(parts)).tolist()]
    return cuts


def _windows(path: str, end: int | None, most: int, block_tokens: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, code = TaskContext.get().partitionId() << 32, encoder(path)
        for docs, null, ids, offsets in blocks(batches, path, end, block_tokens):
            if not len(ids):
                continue
            windows = np.array(split_tail(cut_windows(*cut_points(offsets, code.ends[ids], most), most), most), dtype=np.int64)
            cuts = np.union1d(windows, offsets)
            start, length = cuts[:-1], np.diff(cuts)
            doc = np.searchsorted(offsets, start, side="right") - 1
            window = np.searchsorted(windows, start, side="right") - 1
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(docs[doc], mask=null[doc]),
                    pa.array(start - offsets[doc]),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                    pa.array(np.diff(offsets)[doc]),
                    pa.array(base + window),
                    pa.array(start - windows[window]),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            base += len(windows) - 1

    return run


def pack_in_order(docs: DataFrame, most: int = 4096, end: int | None = 2, path: str | None = None, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of a document in a sequence of at most `most` tokens; documents keep their order.

    doc_id; start (the document's ids before the piece); length; ids_crc32 (of
    the piece's ids as little-endian unsigned 32-bit numbers); doc_tokens;
    sequence_id; offset (of the piece in the sequence). Sequences are padded to
    `most`, except those whose length is a power of two.

    Each run of about `block_tokens` tokens of an input partition is one stream;
    dynamic programming over its documents' and sentences' ends chooses the
    cuts with the least padding plus cut costs (cut_windows). Nothing is
    shuffled; memory is bounded by the run (or by one document that is longer).

    Null and empty texts have the id `end` only, or without `end` no piece. A
    null id stays null; repeated rows are packed each; an empty table gives no
    rows; other columns of docs play no part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(_windows(path or default_path(), end, most, block_tokens), schema)
