"""Substring dedup by sliding spans of sentences."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.columns import set_aside
from plumbline.llm.scratch import Scratch
from plumbline.llm.words import hashes_of_spans, mix, slices, text_bytes, word_spans, _powers

_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?"]] = True
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[[ord(c) for c in "\"')]"]] = True


class Sentences:
    """The sentences of some texts: first and last word, bytes, and hashes of runs of them."""

    def __init__(self, texts: pa.Array, most_words: int):
        self.raw, self.texts = text_bytes(texts)
        starts, ends, docs = word_spans(self.raw, self.texts)
        n = len(starts)
        last = np.zeros(n, dtype=bool)
        if n:
            final = self.raw[ends - 1]
            inner = self.raw[np.maximum(ends - 2, starts)]
            last = _END[final] | (_CLOSING[final] & _END[inner])
            lines = np.concatenate([[0], np.cumsum(self.raw == 10)])
            last[:-1] |= lines[starts[1:]] > lines[ends[:-1]]  # a line break before the next word
            last[docs[1:][np.diff(docs) > 0] - 1] = True
        hashes = hashes_of_spans(self.raw, starts, ends)
        begins = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1]) if n else np.zeros(0, np.int64)
        # a sentence of more than most_words words is cut where its own words say so: the same words are cut alike anywhere
        lengths = np.diff(np.append(begins, n))
        if n and (lengths > most_words).any():
            long = np.repeat(lengths > most_words, lengths)
            inside = np.flatnonzero(long & (hashes % np.uint64(max(2, most_words // 2)) == 0))
            begins = np.union1d(begins, inside)
        self.words = np.append(begins, n)  # the first word of each sentence, and the end
        self.docs = np.searchsorted(begins, docs)  # the first sentence of each text, and the end
        self.starts, self.word_docs = starts, docs
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(hashes * up[:n], out=sums[1:])
        self._sums, self._down = sums, down

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self._sums[b] - self._sums[a]) * self._down[a] + (b - a).astype(np.uint64))

    def spans(self, span: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash (odd), first sentence and text number of every run of `span` sentences of a text that has `least_words` words or more."""
        counts = np.diff(self.docs)
        made = np.maximum(counts - span + 1, 0)
        doc = np.repeat(np.arange(len(counts)), made)
        first = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made) + self.docs[:-1][doc]
        wide = self.words[first + span] - self.words[first] >= least_words
        first, doc = first[wide], doc[wide]
        return (self._hash(self.words[first], self.words[first + span]) | np.uint64(1)).view(np.int64), first, doc

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, text number and anchor of every run of `size` words of a text. The anchor is the least hash (even) of its shorter runs: equal runs have equal anchors wherever they stand, and neighbours mostly share theirs."""
        counts = np.diff(self.word_docs)
        made = np.maximum(counts - size + 1, 0)
        doc = np.repeat(np.arange(len(counts)), made)
        first = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made) + self.word_docs[:-1][doc]
        short = max(1, size * 2 // 5)
        n = len(self.starts)
        if not len(first):
            return first, doc, np.zeros(0, np.int64)
        a = np.arange(n - short + 1)
        least, reach, goal = self._hash(a, a + short) & ~np.uint64(1), 1, size - short + 1
        while reach < goal:  # least[i] is the least of the `reach` hashes from i on
            step = min(reach, goal - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        return first, doc, least[first].view(np.int64)

    def hashes_of_runs(self, first: np.ndarray, size: int) -> np.ndarray:
        return self._hash(first, first + size).view(np.int64)

    def without(self, gone: np.ndarray) -> pa.Array:
        """The texts without the words that are marked; what lies between a word and the next goes with it."""
        ends = np.empty(len(self.starts), dtype=np.int64)
        counts = np.diff(self.word_docs)
        if len(ends):
            ends[:-1] = self.starts[1:]
            full = np.flatnonzero(counts)
            ends[self.word_docs[1:][full] - 1] = self.texts[1:][full]
        change = np.zeros(len(self.raw) + 1, dtype=np.int32)
        np.add.at(change, self.starts[gone], 1)
        np.add.at(change, ends[gone], -1)
        keep = np.cumsum(change[:-1]) == 0
        kept = self.raw[keep]
        offsets = np.concatenate([[0], np.cumsum(keep)])[self.texts]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.texts) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(kept.tobytes())]).cast(pa.large_string()).cast(pa.string())


def _repeats(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the same text has the same span before."""
    again = np.zeros(len(hashes), dtype=bool)
    if len(hashes):
        order = np.lexsort((np.arange(len(hashes)), hashes, doc))
        again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return again


def _again(hashes: np.ndarray, doc: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Whether the same text has the same run of `size` words before, clear of this one."""
    again = np.zeros(len(hashes), dtype=bool)
    if len(hashes):
        order = np.lexsort((first, hashes, doc))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
        at = np.flatnonzero(new)
        again[order] = first[order] - np.repeat(first[order[at]], np.diff(np.append(at, len(order)))) >= size
    return again


def _within(values: np.ndarray, doc: np.ndarray, lists: list) -> np.ndarray:
    """Whether each value is in its text's list; values are in the order of texts."""
    out = np.zeros(len(values), dtype=bool)
    for n, held in enumerate(lists):
        if held:
            i, j = np.searchsorted(doc, [n, n + 1])
            out[i:j] = np.isin(values[i:j], np.array(held, dtype=np.int64))
    return out


def _apart(anchors: np.ndarray, doc: np.ndarray, size: int) -> np.ndarray:
    """Whether the anchor of a run belongs to two or more stretches of runs of its text, or to a stretch that is longer than one place gives."""
    out = np.zeros(len(anchors), dtype=bool)
    if len(anchors):
        new = np.ones(len(anchors), dtype=bool)
        new[1:] = (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        lengths = np.diff(np.append(at, len(anchors)))
        order = np.lexsort((anchors[at], doc[at]))
        same = np.zeros(len(at) + 1, dtype=bool)
        same[1:-1] = (anchors[at][order[1:]] == anchors[at][order[:-1]]) & (doc[at][order[1:]] == doc[at][order[:-1]])
        more = np.zeros(len(at), dtype=bool)
        more[order] = same[1:] | same[:-1]
        out = np.repeat(more | (lengths > size), lengths)
    return out


def _list_spans(span: int, least_words: int, most_words: int, run_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, "text"):
                    found = Sentences(part.column("text"), most_words)
                    hashes, _, doc = found.spans(span, least_words)
                    _, of_run, anchors = found.runs(run_words)
                    other = np.ones(len(anchors), dtype=bool)  # most neighbours share their anchor
                    other[1:] = (anchors[1:] != anchors[:-1]) | (of_run[1:] != of_run[:-1])
                    hashes, doc = np.concatenate([hashes, anchors[other]]), np.concatenate([doc, of_run[other]])
                    first = ~_repeats(hashes, doc)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[first]), part.column("id").take(pa.array(doc[first]))], names=["span", "id"])

    return run


def _list_runs(most_words: int, run_words: int, id_col: str, text_col: str) -> Callable:
    """Hashes of the runs of words whose anchor another text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                held = batch.filter(pc.greater(pc.fill_null(pc.list_value_length(batch.column("_anchors")), 0), 0))
                for part in slices(held, text_col):
                    found = Sentences(part.column(text_col), most_words)
                    first, doc, anchors = found.runs(run_words)
                    shared = _within(anchors, doc, part.column("_anchors").to_pylist())
                    first, doc = first[shared], doc[shared]
                    hashes = found.hashes_of_runs(first, run_words)
                    new = ~_repeats(hashes, doc)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes[new]), part.column(id_col).cast(pa.int64()).take(pa.array(doc[new]))], names=["span", "id"])

    return run


def _remove(span: int, least_words: int, most_words: int, run_words: int, columns: list[str], text_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                for part in slices(batch, text_col):
                    texts = part.column(text_col)
                    found = Sentences(texts, most_words)
                    hashes, first, doc = found.spans(span, least_words)
                    repeated = _repeats(hashes, doc) | _within(hashes, doc, part.column("_spans").to_pylist())
                    cover = np.zeros(len(found.starts) + 1, dtype=np.int64)
                    np.add.at(cover, found.words[first[repeated]], 1)
                    np.add.at(cover, found.words[first[repeated] + span], -1)
                    # the same for runs of words; only where the anchor comes again can a run come again in its text
                    first, doc, anchors = found.runs(run_words)
                    runs = part.column("_runs").to_pylist()
                    asked = np.array([bool(r) for r in runs], dtype=bool)[doc]
                    maybe = asked | _apart(anchors, doc, run_words)
                    first, doc = first[maybe], doc[maybe]
                    hashes = found.hashes_of_runs(first, run_words)
                    begin = first[_again(hashes, doc, first, run_words) | _within(hashes, doc, runs)]
                    np.add.at(cover, begin, 1)
                    np.add.at(cover, begin + run_words, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    words = np.concatenate([[0], np.cumsum(gone)])[found.words]
                    totals = np.concatenate([[0], np.cumsum(np.diff(words) > 0)])
                    kept = found.without(gone)
                    if texts.null_count:
                        kept = pa.array([None if t is None else k for t, k in zip(texts.to_pylist(), kept.to_pylist(), strict=True)], pa.string())
                    out = [kept if c == text_col else part.column(c) for c in columns]
                    yield pa.RecordBatch.from_arrays(
                        [*out, pa.array(np.diff(found.docs)), pa.array(totals[found.docs[1:]] - totals[found.docs[:-1]])], names=[*columns, "_sentences", "_removed"]
                    )

    return run


def remove_repeated_spans(docs: DataFrame, span: int = 3, least_words: int = 12, most_words: int = 24, run_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with shortened texts and the columns _sentences (before) and _removed (those that lost words).

    A sentence ends at a word that ends with . ! or ? (closing quotes and
    brackets may follow), or at a line break; a longer run than `most_words`
    words is also cut at words chosen by their hash. Spans are runs of `span`
    sentences of one text with `least_words` words or more (three sentences of a
    word each may well meet by chance), compared by their words (A-Z as a-z) whatever the
    white space. A span that occurs more than once stays only where it comes
    first, by id and then by place; every sentence that any other occurrence
    covers is taken out of its text, with the white space after it.

    Beside the spans, every run of `run_words` words counts, wherever it begins
    and ends: it too stays only where it comes first (in one text: clear of the
    first), so a longer repeated passage goes from its first word to its last.
    Runs are hashed only where they may repeat: the anchor of a run, the least
    hash of its shorter runs, must occur in two texts.

    Only hashes and ids are shuffled before the hits go to their documents; they
    are pre-aggregated, so a passage that many documents share is one row for
    each map task, and the join that finds its documents can be split. Texts are
    shuffled once, for both joins.

    Null texts stay null and empty ones empty. Rows with a null id are compared
    with nothing but themselves. Rows that share an id count as one occurrence
    (each is shortened alike). Texts of fewer than `span` sentences and
    `run_words` words stay as they are. An empty table gives no rows. Other
    columns pass through unchanged, whatever their names; one named _sentences
    or _removed comes back as _sentences_in or _removed_in.
    """
    docs, names, back = set_aside(docs)
    id_col, text_col = names[id_col], names[text_col]
    scratch = Scratch(docs.sparkSession, "substring")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    spans = rows.mapInArrow(_list_spans(span, least_words, most_words, run_words), "span long, id long")

    def repeats(found: DataFrame) -> DataFrame:
        """found (span, id) of the spans of two ids or more, with the first id.

        These spans are a written table, so that the join is one of two plain
        sides: Spark broadcasts a small one and splits the rows of a span that
        very many documents share.
        """
        shared = found.groupBy("span").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("span", "first")
        return found.join(scratch.keep(shared, "shared"), "span")

    sentence = F.col("span").bitwiseAND(F.lit(1)) == 1
    hits = repeats(spans).where((F.col("id") > F.col("first")) | ~sentence).groupBy(F.col("id").alias("_id"))
    hits = scratch.keep(hits.agg(F.collect_set(F.when(sentence, F.col("span"))).alias("_spans"), F.collect_set(F.when(~sentence, F.col("span"))).alias("_anchors")), "hits")
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    key = F.col(id_col).cast("long") == F.col("_id")
    runs = docs.join(hits.select("_id", "_anchors").hint("merge"), key, "left").mapInArrow(_list_runs(most_words, run_words, id_col, text_col), "span long, id long")
    runs = repeats(runs).where("id > first").groupBy(F.col("id").alias("_id")).agg(F.collect_set("span").alias("_runs"))
    both = hits.select("_id", "_spans").join(runs.hint("merge"), "_id", "left")  # what has runs has anchors
    joined = docs.join(both.hint("merge"), key, "left").drop("_id")
    clean = joined.mapInArrow(_remove(span, least_words, most_words, run_words, columns, text_col), f"{schema}, _sentences long, _removed long")
    return back(clean, ["_sentences", "_removed"])
