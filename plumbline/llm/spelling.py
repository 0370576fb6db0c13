"""Spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all distinct strings that one deletion,
replacement or insertion over the observed alphabet makes of it; the ones that
are words themselves are its near words. The join of strings is exact, so no
distance is ever worked out. Before the join a Bloom filter of the vocabulary,
of bounded size, leaves out nearly all strings that are no word; it never
leaves out a word, and where the vocabulary outgrows it, more strings reach
the join and the result stays the same.

Distinct by construction: of a run of equal letters only the first is deleted,
nothing is replaced by itself, and a letter isn't inserted behind its equal.

Results in odd cases: null and empty texts have no words; a null id counts as
the empty text; repeated rows count as often as they occur; equally frequent
near words go by code points; an empty table gives no rows. A word may be of
any length: its strings are made in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.columns import set_aside
from plumbline.llm.scratch import Scratch
from plumbline.llm.words import mix

#: Bits of the filter for each word, bounds for their number as powers of two, and bits that a word sets.
BITS_PER_WORD = 16
LEAST_BITS, MOST_BITS = 16, 28
PROBES = 4

#: Strings that are made at a time.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
_UP = np.uint64(_BASE)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text", letters: str = r"A-Za-zÀ-ÿ", least_length: int = 6, least_count: int = 5, one_in: int = 199) -> DataFrame:
    """Words and their numbers of occurrences (word, n).

    Runs of letters, A-Z as a-z. A run whose h, the crc32 of `<id>:<run>`, is a
    multiple of `one_in` loses its code point h % length. Runs that are too
    short before are never looked at, as no run gets longer.
    """
    plain, names, _ = set_aside(docs)
    runs = plain.select(F.coalesce(F.col(names[id]).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(names[text]), F.lit(f"[{letters}]{{{least_length},}}"), F.lit(0))).alias("run"))
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER)).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# --- hashes of words, and of all strings around a word ---


def _symbols(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x1F3D5B79))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _UP, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), length)


def _finished(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + np.uint64(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def word_sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """before[:, i]: the sum of symbol x power over places under i, for words of one length (a row of code points each); and the powers."""
    powers = _powers(points.shape[1] + 1)
    before = np.zeros((len(points), points.shape[1] + 1), dtype=np.uint64)
    np.cumsum(_symbols(points) * powers[:-1], axis=1, out=before[:, 1:])
    return before, powers


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield (hashes + np.uint64(i) * step) & np.uint64((1 << bits) - 1)


def _maybe(lanes: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Indices of the hashes that the filter lets through."""
    left = np.arange(len(hashes))
    for i in range(PROBES):
        some = hashes[left]
        at = (some + np.uint64(i) * ((some >> np.uint64(32)) | np.uint64(1))) & np.uint64((1 << bits) - 1)
        left = left[(lanes[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return left


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    yield from groups.items()


def neighbourhood(words: list[str], alphabet: str, lanes: np.ndarray | None = None, bits: int = 0) -> Iterator[tuple[int, str]]:
    """All distinct strings one edit from each word, with the word's index; with a filter, only those that it lets through."""
    letters = np.frombuffer(alphabet.encode("utf-32-le"), dtype="<u4")
    values = _symbols(letters)

    def passed(sums: np.ndarray, fit: np.ndarray, length: int) -> np.ndarray:
        places = np.flatnonzero(fit.ravel())
        return places if lanes is None else places[_maybe(lanes, _finished(sums.ravel()[places], length), bits)]

    for length, rows in _by_length(words):
        many = max(1, BLOCK // ((length + 1) * len(alphabet) or 1))
        wide = max(1, BLOCK // max(1, len(alphabet)))  # places at a time: a word may be longer than a block
        for i in range(0, len(rows), many):
            some = rows[i : i + many]
            points = _points([words[r] for r in some], length)
            before, powers = word_sums(points)
            whole = before[:, -1:]
            for j in range(0, length + 1, wide):
                k = min(length, j + wide)  # places j .. k - 1 of letters; insertions also behind the last letter
                here = points[:, j:k]
                as_before = np.zeros(here.shape, dtype=bool)  # the same letter stands before it
                as_before[:, (0 if j else 1) :] = points[:, max(j, 1) : k] == points[:, max(j, 1) - 1 : k - 1]
                after = whole - before[:, j + 1 : k + 1]
                for x in passed(before[:, j:k] + after * _BACK, ~as_before, length - 1):
                    r, p = divmod(int(x), k - j)
                    w = words[some[r]]
                    yield some[r], w[: j + p] + w[j + p + 1 :]
                rest = whole - (before[:, j + 1 : k + 1] - before[:, j:k])
                made = rest[:, :, None] + (powers[j:k, None] * values[None, :])[None]
                for x in passed(made, here[:, :, None] != letters[None, None, :], length):
                    r, p, c = np.unravel_index(x, made.shape)
                    w = words[some[r]]
                    yield some[r], w[: j + p] + alphabet[c] + w[j + p + 1 :]
                last = min(length + 1, j + wide)
                made = (before[:, j:last] + (whole - before[:, j:last]) * _UP)[:, :, None] + (powers[j:last, None] * values[None, :])[None]
                fit = np.ones(made.shape, dtype=bool)  # not behind the same letter
                start = max(j, 1)
                fit[:, start - j :] = points[:, start - 1 : last - 1, None] != letters[None, None, :]
                for x in passed(made, fit, length + 1):
                    r, p, c = np.unravel_index(x, made.shape)
                    w = words[some[r]]
                    yield some[r], w[: j + p] + alphabet[c] + w[j + p :]


# --- the filter, and the join ---


def word_filter(words: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of the words in lanes of 64 bits: made by a grouped shuffle; the driver gets at most 2^MOST_BITS bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, count) * BITS_PER_WORD)))))

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0).to_pylist()
            for length, rows in _by_length(held):
                hashes = _finished(word_sums(_points([held[r] for r in rows], length))[0][:, -1], length)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(_probes(hashes, bits))).astype(np.int64))], names=["bit"])

    set_bits = words.select("word").mapInArrow(probes, "bit long")
    found = set_bits.groupBy(F.shiftright("bit", 6).alias("lane")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    lanes = np.zeros(1 << (bits - 6), dtype=np.uint64)
    lanes[found.column("lane").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return lanes, bits


def near_words(spark: SparkSession, words: DataFrame, count: int) -> DataFrame:
    """For every word (word, n) that has near words: n_near, and the most frequent of them with its number, as best and best_n."""
    alphabet = "".join(sorted(r[0] for r in words.select(F.explode(F.split("word", ""))).distinct().collect() if r[0]))  # no more than there are letters
    lanes, bits = word_filter(words, count)
    sent = spark.sparkContext.broadcast(lanes)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                held = batch.slice(i, 2000).column("word").to_pylist()
                rows, made, size = [], [], 0
                for row, string in neighbourhood(held, alphabet, sent.value, bits):
                    rows.append(row)
                    made.append(string)
                    size += len(string)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([held[r] for r in rows]), pa.array(made)], names=["word", "near"])
                        rows, made, size = [], [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([held[r] for r in rows]), pa.array(made)], names=["word", "near"])

    strings = words.select("word").mapInArrow(emit, "word string, near string")
    near = strings.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    return near.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("best"), (-F.col("best.n")).alias("best_n"))


def roots(scratch: Scratch, links: DataFrame) -> DataFrame:
    """The last form (word, root) that is reached from each word of links (word, form).

    Links are followed two, four, eight ... steps at once; forms are several
    times as frequent as their words, so that chains are short and never closed.
    """
    links = scratch.keep(links.select("word", F.col("form").alias("root")), "links")
    while True:
        far = links.select(F.col("word").alias("at"), F.col("root").alias("further"))
        moved = scratch.keep(links.join(far, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links")
        done = not moved.where("moved").limit(1).count()
        links = moved.select("word", "root")
        if done:
            return links


def variants(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", times: int = 5) -> DataFrame:
    """Every word of the vocabulary: word, form (its most frequent near word, if that is `times` as frequent), root (the last form), n, n_near, form_n."""
    scratch = Scratch(spark, "spelling")
    words = scratch.keep(vocabulary(docs, id, text), "vocabulary")
    near = near_words(spark, words, words.count())
    is_form = F.col("best_n") >= times * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    found = scratch.keep(found, "near")
    last = roots(scratch, found.where("form is not null"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
