"""Words of whole texts as 64-bit hashes, worked out for many documents at a time.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z count as a-z. All
functions take and return numpy arrays over the documents of one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at a time (a longer text is handled alone).
SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        m = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(m, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold about `most` bytes of text."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(sizes, dtype=np.int64) // most
    cuts = np.flatnonzero(np.diff(run)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(i, j - i)
    pa.default_memory_pool().release_unused()  # the worker lives on beside the executor's heap


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts (null: empty) and the n + 1 offsets of the texts in them."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and n + 1 offsets of the documents among the words."""
    raw, offsets = text_bytes(texts)
    starts, ends, docs = word_spans(raw, offsets)
    return hashes_of_spans(raw, starts, ends), docs


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the bytes, and the offsets of the documents among the words."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[raw]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True  # a text begins here
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, ~word[:-1]
    starts = np.flatnonzero(word & (before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, ~word[1:]
    ends = np.flatnonzero(word & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes_of_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes (A-Z as a-z) of each span."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_LOWER[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `width` words; a text of fewer words (but at least one) has all of them as its only run."""
    counts = np.diff(offsets)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_offsets = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(made, out=out_offsets[1:])
    out = np.zeros(out_offsets[-1], dtype=np.uint64)
    n = len(hashes)
    if n >= width:
        rolled = hashes[: n - width + 1].copy()
        for j in range(1, width):
            rolled *= _STEP
            rolled += hashes[j : n - width + 1 + j]
        rolled = mix(rolled)
        long = np.flatnonzero(counts >= width)
        if len(long):
            m = made[long]
            shift = np.repeat(offsets[long] - out_offsets[long], m)
            at = np.repeat(out_offsets[long] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            out[at] = rolled[at + shift]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        value = np.uint64(0)
        for h in hashes[offsets[i] : offsets[i + 1]]:
            value = value * _STEP + h
        out[out_offsets[i]] = mix(np.array([value + np.uint64(counts[i])]))[0]
    return out, out_offsets


def distinct_sorted(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each document, ascending."""
    values = values.copy()
    bounds = offsets.tolist()
    for i, j in zip(bounds, bounds[1:], strict=False):
        values[i:j].sort()
    if not len(values):
        return values, offsets
    new = np.empty(len(values), dtype=bool)
    new[0], new[1:] = True, values[1:] != values[:-1]
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[offsets]
