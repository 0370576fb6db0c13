"""Toxicity by compression distance: two zstandard dictionaries, and how well each shortens the windows of a text."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import slices, text_bytes

#: Labelled documents that a fit reads at most, of either kind (those with the smallest hashes of their ids).
MOST_TOXIC, MOST_ORDINARY = 2000, 4000
#: Bytes of the toxic and of the ordinary dictionary that zstandard trains, and its level. Up to HARD_WORDS words, the most frequent of those that the ordinary documents have and the trained dictionaries take for toxic, follow the ordinary one.
TOXIC_BYTES, ORDINARY_BYTES, LEVEL, HARD_WORDS = 8192, 32_768, 16, 4000
#: Segment and substring length of the dictionary trainer.
SEGMENT, SUBSTRING = 64, 8
#: A window is a word in this frame; both dictionaries know the frame, so the cost of a first match is paid on both sides.
FRAME = b"\n\n\n\n"
#: A word is toxic text if so many toxic training documents have it, so many times as often as ordinary ones.
LEAST_DOCUMENTS, LEAST_RATIO = 3, 20.0
#: Bytes by which the toxic dictionary must shorten a window further for it to count.
THRESHOLDS = (4, 5, 7)
#: One of so many labelled documents of either kind calibrates the thresholds and teaches the dictionaries nothing.
HELD_BACK = 4
#: Words that a worker remembers the gains of.
REMEMBERED = 200_000


def _words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words (A-Z as a-z), the words as numbers of these, and the texts' n + 1 offsets."""
    raw, bounds = text_bytes(texts)
    small = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)  # in numpy: Arrow's own lower case misreads slices
    lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(small)))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    return words.dictionary.cast(pa.large_binary()).to_pylist(), words.indices.to_numpy().astype(np.int64), offsets - offsets[0]


@dataclass
class Toxicity:
    """Two dictionaries and the calibration of what they tell of a document."""

    toxic: bytes = b""
    ordinary: bytes = b""
    prior: float = 0.0
    centre: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self) -> None:
        self._gains: dict[bytes, int] = {}
        self._pair = None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.__post_init__()

    def gains(self, words: Iterable[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one on each word in its frame."""
        words = list(words)
        new = [w for w in words if w not in self._gains]
        if new:
            if len(self._gains) + len(new) > REMEMBERED:
                self._gains.clear()
                new = words
            ordinary, toxic = self._compressors()
            framed = [FRAME + w + FRAME for w in new]
            for i in range(0, len(framed), 20_000):
                a, b = (c.multi_compress_to_buffer(framed[i : i + 20_000], threads=0) for c in (ordinary, toxic))
                self._gains.update((new[i + k], len(a[k]) - len(b[k])) for k in range(len(a)))
        return np.fromiter((self._gains[w] for w in words), np.int64, len(words))

    def _compressors(self) -> tuple:
        if self._pair is None:
            import zstandard as z

            level = z.ZstdCompressionParameters.from_level(LEVEL, write_checksum=0, write_content_size=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
            self._pair = tuple(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=level) for d in (self.ordinary, self.toxic))
        return self._pair

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: its greatest gains (of different words), windows over each threshold, and their share."""
        names, codes, offsets = _words(texts)
        gains = self.gains(names)
        out = np.zeros((len(texts), 3 + 2 * len(THRESHOLDS) + 1))
        over = np.flatnonzero(gains[codes] >= 2)
        doc = np.searchsorted(offsets, over, side="right") - 1
        for n, at in zip(*_groups(doc), strict=True):
            some = gains[np.unique(codes[over[at]])]
            top = np.sort(some)[::-1][:3]
            out[n, : len(top)] = top
            every = gains[codes[over[at]]]
            for k, threshold in enumerate(THRESHOLDS):
                out[n, 3 + k] = np.log1p((every >= threshold).sum())
                out[n, 3 + len(THRESHOLDS) + k] = np.log1p((some >= threshold).sum())
        sizes = np.maximum(1, np.diff(offsets))
        out[:, -1] = np.log1p(np.bincount(doc, weights=np.maximum(gains[codes[over]] - 3, 0), minlength=len(texts)) / sizes * 100)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        x = (self.features(texts) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -40, 40)))


def _groups(sorted_values: np.ndarray) -> tuple[list[int], list[slice]]:
    if not len(sorted_values):
        return [], []
    starts = np.flatnonzero(np.diff(sorted_values, prepend=sorted_values[0] - 1))
    ends = [*starts[1:].tolist(), len(sorted_values)]
    return sorted_values[starts].tolist(), [slice(a, b) for a, b in zip(starts.tolist(), ends, strict=True)]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the first is the intercept, which isn't penalised) by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary that zstandard trains on the samples; too few samples for its trainer are the dictionary themselves."""
    import zstandard as z

    samples = [x for x in samples if len(x) > 2 * len(FRAME)]
    try:
        return z.train_dictionary(size, samples, k=SEGMENT, d=SUBSTRING).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


def train(texts: pa.Array, toxic: np.ndarray, whole_share: float | None = None, held_back: int = HELD_BACK) -> Toxicity:
    """Dictionaries from whole labelled texts, and their calibration on the texts that are held back for it: one of each `held_back` of either kind.

    With too few texts for that (less than 20 of a kind), all serve for both.
    """
    rank = np.where(toxic == 1, np.cumsum(toxic == 1), np.cumsum(toxic != 1))
    aside = rank % held_back == 0
    if min((toxic == 1).sum(), (toxic != 1).sum()) < 20:
        return _train(texts, toxic, whole_share)
    share = float((toxic == 1).mean()) if whole_share is None else whole_share
    return _train(texts.filter(pa.array(~aside)), toxic[~aside], share, (texts.filter(pa.array(aside)), toxic[aside]))


def _train(texts: pa.Array, toxic: np.ndarray, whole_share: float | None = None, back: tuple[pa.Array, np.ndarray] | None = None) -> Toxicity:
    """Dictionaries from the texts, and calibration on `back` (the texts themselves, if not given).

    Windows are words in a frame. Toxic text are the windows of toxic documents
    whose word these have far more often than ordinary ones, ordinary text all
    windows of ordinary documents; zstandard trains a dictionary on either. The
    ordinary words that these at first take for toxic follow the ordinary one.
    The calibration is
    a logistic regression on the documents' features, in which documents count
    so that toxic ones have the share `whole_share` (that of the sample, if not
    given).
    """
    names, codes, offsets = _words(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    pairs = np.unique(doc * len(names) + codes) if len(names) else np.zeros(0, np.int64)
    has, word = np.divmod(pairs, max(1, len(names)))
    bad = np.bincount(word[toxic[has] == 1], minlength=len(names))
    good = np.bincount(word[toxic[has] == 0], minlength=len(names))
    n_bad, n_good = int(toxic.sum()), int(len(toxic) - toxic.sum())
    prior = whole_share if whole_share is not None else n_bad / max(1, len(toxic))
    if not n_bad or not n_good:
        return Toxicity(prior=float(prior))
    expected = n_bad * (good + 0.5) / (n_good + 1)
    picked = np.flatnonzero((bad >= LEAST_DOCUMENTS) & (bad > LEAST_RATIO * expected))
    picked = picked[np.argsort((bad - expected)[picked] / np.sqrt(expected[picked]), kind="stable")]
    telling = np.zeros(len(names), dtype=bool)
    telling[picked] = True
    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for i in range(len(texts)):
        run = codes[offsets[i] : offsets[i + 1]]
        samples[int(toxic[i] == 1)].append(b"".join(FRAME + names[c] for c in (run[telling[run]] if toxic[i] == 1 else run)) + FRAME)
    bad_text, good_text = _dictionary(samples[1], TOXIC_BYTES), _dictionary(samples[0], ORDINARY_BYTES)
    gains = Toxicity(toxic=bad_text, ordinary=good_text).gains(names)
    hard = np.flatnonzero((gains >= 3) & (good > 0) & (bad <= expected * 3))
    hard = hard[np.argsort(good[hard], kind="stable")][-HARD_WORDS:]
    model = Toxicity(toxic=bad_text, ordinary=good_text + FRAME + b"".join(names[i] + FRAME for i in hard.tolist()))
    held, y = (texts, toxic) if back is None else back
    x = model.features(held)
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    w = _logistic((x - centre) / scale, y.astype(float))
    sample = float(y.mean())
    if 0 < prior < 1:  # from the sample's share to that of all rows
        w[0] += np.log(prior / (1 - prior)) - np.log(sample / (1 - sample))
    return Toxicity(model.toxic, model.ordinary, float(prior), centre, scale, w)


def fit(docs: DataFrame, labels: DataFrame, rows: Column | None = None, most_toxic: int = MOST_TOXIC, most_ordinary: int = MOST_ORDINARY, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """A model from a bounded sample of labelled documents: most_toxic and most_ordinary rows at most.

    rows limits the ids that may be learnt from. Of several labels of an id the
    greatest counts; rows with null ids or labels teach nothing. The share of
    toxic documents is counted over all labelled rows. Without toxic or without
    ordinary documents every score is that share (0, if there are no labels).
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    if rows is not None:
        known = known.where(rows)
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0] or 0.0
    order = [F.xxhash64("id"), F.col("id")]
    sample = known.where("y = 1").orderBy(*order).limit(most_toxic).union(known.where("y = 0").orderBy(*order).limit(most_ordinary))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(sample), "id").repartition(1).sortWithinPartitions(*order, "text")  # most_toxic + most_ordinary ids
    made = found.select("y", "text").mapInArrow(_train_task(float(share)), "model binary").first()
    return pickle.loads(made.model) if made else Toxicity(prior=float(share))


def _train_task(share: float) -> Callable:
    """The bounded sample's rows -> one row with the model; it is trained in a task, so the driver only gets the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            table = pa.Table.from_batches(rows)
            model = train(table.column("text").combine_chunks(), table.column("y").to_numpy(), share)
            del rows, table
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def _score(model: Toxicity) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(model.scores(part.column("text")))], names=["id", "score"])

    return run


def score(docs: DataFrame, model: Toxicity, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of docs; score is the model's chance that the whole text is toxic.

    Each word is a window: it is compressed with either dictionary, and what the
    toxic one saves beyond the ordinary one is its gain; the texts' greatest
    gains and the windows over fixed thresholds are weighed together. Null and
    empty texts score like a text without any gain. Null ids stay null, repeated
    rows are scored each, an empty table gives no rows, other columns play no
    part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_score(model), "id long, score double").withColumnRenamed("id", id_col)


def _keep(model: Toxicity, threshold: float, text_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 4 << 20):
                yield part.filter(pa.array(model.scores(part.column(text_col)) < threshold))

    return run


def without_toxic(docs: DataFrame, model: Toxicity, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns unchanged, whose score (see `score`) is under the threshold."""
    return docs.mapInArrow(_keep(model, threshold, text_col), docs.schema)
