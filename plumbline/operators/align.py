"""Alignment of two tokenisations of a text, and what sequences share.

Tokens are rows. Python runs only where the longest common run of two
sequences is asked for, in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import asof

RUN = T.StructType([T.StructField(c, T.IntegerType()) for c in "ijn"])


def longest_common(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common run of two arrays of integers, of several the first in a, then in b; (-1, -1, 0) if there is none.

    Runs of 1, 2, 4 ... elements are numbered until no number stands on both
    sides; the length between the last two is found by halving, as a run of any
    length is told by its first and its last half. No hashes, so no collisions.
    """
    values = np.concatenate([a, b])
    cut, most = len(a), min(len(a), len(b))

    def codes(names: np.ndarray, half: int, n: int) -> np.ndarray:
        first, last = names[: len(values) - n + 1], names[n - half : n - half + len(values) - n + 1]
        return first * np.int64(len(values) + 1) + last

    def shared(code: np.ndarray, n: int) -> np.ndarray:
        return np.intersect1d(code[: cut - n + 1], code[cut:])

    if not most:
        return -1, -1, 0
    names, half = np.unique(values, return_inverse=True)[1].astype(np.int64), 1
    if not len(shared(names, 1)):
        return -1, -1, 0
    while 2 * half <= most and len(shared(code := codes(names, half, 2 * half), 2 * half)):
        names, half = np.unique(code, return_inverse=True)[1].astype(np.int64), 2 * half
    low, high = half, min(2 * half - 1, most)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if len(shared(codes(names, half, middle), middle)) else (low, middle - 1)
    code = codes(names, half, low)
    found = shared(code, low)
    i = int(np.isin(code[: cut - low + 1], found).argmax())
    return i, int((code[cut:] == code[i]).argmax()), low


def _signs(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


@F.pandas_udf(RUN)
def longest_common_text(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The longest common run of signs of two texts."""
    return pd.DataFrame([longest_common(_signs(x), _signs(y)) for x, y in zip(a, b, strict=True)], columns=["i", "j", "n"])


@F.pandas_udf(RUN)
def longest_common_run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The longest common run of two arrays of longs (hashes of elements)."""
    return pd.DataFrame([longest_common(np.asarray(x, dtype=np.int64), np.asarray(y, dtype=np.int64)) for x, y in zip(a, b, strict=True)], columns=["i", "j", "n"])


def aligned_tokens(a: DataFrame, b: DataFrame, key: str, pos: str = "pos", token: str = "token", width: int = 256) -> DataFrame:
    """For each token row of a (key, pos) the places of the tokens of b that share a sign with it, as an ascending array.

    Tokens are compared without white space. Where the joined texts of a key
    differ, only their longest common run of signs counts, and a token outside
    it has none; only such texts go to Python. Intervals meet in buckets of
    `width` signs, so that a long text is split over tasks.
    """
    blank = lambda df: df.select(key, pos, F.regexp_replace(token, r"\s+", "").alias("_t"))
    joined = lambda df, name: df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "_t"))), lambda x: x["_t"]), "").alias(name))
    a, b = blank(a), blank(b)
    texts = joined(a, "_left").join(joined(b, "_right"), key)
    same = F.col("_left") == F.col("_right")
    whole = texts.where(same).select(key, F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.length("_left").alias("n")).alias("_at"))
    part = texts.where(~same).select(key, longest_common_text("_left", "_right").alias("_at"))
    region = whole.union(part).select(key, "_at.*")

    def within(df: DataFrame, offset: str) -> DataFrame:
        placed = spans(df, key, pos, "_t").join(region, key)
        start, end = F.col("start") - F.col(offset), F.col("end") - F.col(offset)
        return placed.select(key, pos, F.greatest(start, F.lit(0)).alias("start"), F.least(end, F.col("n")).alias("end"))

    pairs = asof.overlaps(within(a, "i"), within(b, "j"), key, width)
    found = pairs.groupBy(key, pos).agg(F.array_sort(F.collect_list(f"b_{pos}")).alias("matches"))
    return a.select(key, pos).join(found, [key, pos], "left").withColumn("matches", F.coalesce("matches", F.array().cast(found.schema["matches"].dataType)))


def spans(df: DataFrame, key: str, pos: str, token: str) -> DataFrame:
    """df with start and end (signs) of each token in its text."""
    upto = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length(token)).over(upto)
    return df.withColumn("end", end.cast("long")).withColumn("start", (F.col("end") - F.length(token)).cast("long"))


def token_spans(tokens: DataFrame, asked: DataFrame, key: str, pos: str, first: str, last: str, width: int = 4096) -> DataFrame:
    """asked with first_token and last_token: the tokens (rows with start and end) of its key that hold the signs at the places first and last; null before the first token.

    Two as-of joins, so that a long text's tokens are spread over tasks.
    """
    starts = tokens.where("end > start").select(key, F.col("start").alias("_at"), F.col(pos).alias("_token"))
    found = asked
    for place, name in ((first, "first_token"), (last, "last_token")):
        known = starts.select(key, F.col("_at").alias(place), F.col("_token").alias(name))
        found = asof.asof(found, known, [key], place, [name], width, [name])
    return found


def at_every(tokens: DataFrame, key: str, pos: str, step: int) -> DataFrame:
    """(key, place, pos, start): the tokens (rows with start and end, one after the other) that hold the places 0, step, 2 * step and so on.

    Each token tells by itself which of these places it holds, so no row is joined or exchanged.
    """
    first = F.expr(f"(start + {step - 1}) div {step} * {step}")
    held = F.when(first < F.col("end"), F.sequence(first, F.col("end") - 1, F.lit(step).cast("long")))
    return tokens.select(key, pos, "start", F.explode(held).alias("place")).select(key, "place", pos, "start")


def holding(tokens: Column, first: Column, last: Column) -> Column:
    """(first, last): the places (from 0) of the elements of an array of texts that hold the signs first and last (from 0) of the joined text; null past its end."""
    none = F.lit(None).cast("int")
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("i"), none.alias("first"), none.alias("last"))

    def add(s: Column, t: Column) -> Column:
        end = s["end"] + F.length(t)
        inside = lambda at, old: F.when((s["end"] <= at) & (at < end), s["i"]).otherwise(old)
        return F.struct(end.alias("end"), (s["i"] + 1).alias("i"), inside(first, s["first"]).alias("first"), inside(last, s["last"]).alias("last"))

    return F.aggregate(tokens, begin, add, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _matched(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text of a the first place in b of a text that shares a sign with it (-1 if none) and the number of such texts."""
    left, right = "".join(a), "".join(b)
    i, j, n = (0, 0, len(left)) if left == right else longest_common(_signs(left), _signs(right))

    def spans(texts: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
        width = np.fromiter(map(len, texts), np.int64, len(texts))
        end = np.cumsum(width) - offset
        return np.maximum(end - width, 0), np.minimum(end, n)

    (start, end), (b_start, b_end) = spans(a, i), spans(b, j)
    full = np.flatnonzero(b_start < b_end)
    low, high = np.searchsorted(b_end[full], start, "right"), np.searchsorted(b_start[full], end, "left")
    count = np.where(start < end, high - low, 0)
    first = np.full(len(a), -1)
    first[count > 0] = full[low[count > 0]]
    return first, count


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("first", "n")]))
def matched(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """What aligned_tokens tells, for two arrays of texts without white space in a row: of each text of a the first place in b that shares a sign with it (-1 if none), and how many do."""
    return pd.DataFrame([_matched(x, y) for x, y in zip(a, b, strict=True)], columns=["first", "n"])


def aligned_prob(pairs: DataFrame, tokens: DataFrame, key: str, pos: str, prob: str) -> DataFrame:
    """Each token's probability from the overlapping scored ones: the least of several, the mean over the key's scored tokens if none."""
    least = pairs.groupBy(key, pos).agg(F.min(f"b_{prob}").alias("_p"))
    mean = pairs.select(key, F.col("b_pos").alias("_b"), F.col(f"b_{prob}").alias("_q")).distinct().groupBy(key).agg(F.avg("_q").alias("_mean"))
    return tokens.join(least, [key, pos], "left").join(mean, key, "left").withColumn("aligned", F.coalesce("_p", "_mean")).drop("_p", "_mean")


def closer(a: DataFrame, b: DataFrame, key: str, equal: str = "equal") -> DataFrame:
    """key, n, changed_*, share_* (equal ones by all) of the same tokens compared with two references, and which of them is closer.

    a and b hold a row for each token with whether it stays on the way to their
    reference; sums are joined, not tokens. A key that only one side has doesn't come.
    """
    count = lambda df, s: df.groupBy(key).agg(F.count("*").alias(f"_n{s}"), F.count_if(equal).alias(f"_e{s}"))
    both = count(a, "a").join(count(b, "b"), key)
    ca, cb = F.col("_na") - F.col("_ea"), F.col("_nb") - F.col("_eb")
    return both.select(
        key,
        F.col("_na").alias("n"),
        ca.alias("changed_a"),
        cb.alias("changed_b"),
        (F.col("_ea") / F.col("_na")).alias("share_a"),
        (F.col("_eb") / F.col("_nb")).alias("share_b"),
        (cb < ca).alias("b_changes_less"),
        (F.col("_eb") > F.col("_ea")).alias("b_more_equal"),
        (F.col("_eb") == F.col("_ea")).alias("same"),
    )


def array_means(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and the element-wise means of each array column over the key's rows; a shorter array has no say in the places that it lacks."""
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("array<double>").alias("v")) for c in columns])).alias("s")).select(key, "s.c", F.posexplode("s.v").alias("i", "x"))
    means = long.groupBy(key, "c", "i").agg(F.avg("x").alias("m"))
    made = [F.transform(F.array_sort(F.collect_list(F.when(F.col("c") == c, F.struct("i", "m")))), lambda s: s["m"]).alias(c) for c in columns]
    return means.groupBy(key).agg(*made)


def first_run(tokens: Column, run: Column) -> Column:
    """Place (from 0) of the first occurrence of an array within another; null if there is none."""
    places = F.sequence(F.lit(0), F.size(tokens) - F.size(run))
    return F.when(F.size(tokens) >= F.size(run), F.get(F.filter(places, lambda i: F.slice(tokens, i + 1, F.size(run)) == run), F.lit(0)))


#: Words by which texts and long items find each other, and signs by which words and parts of short items do.
WORDS, SIGNS = 5, 4


def containing(texts: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item: str) -> DataFrame:
    """(key, item_key) of all texts that hold an item's whole text.

    An item's first and last word may be parts of longer words of the text, but
    the words between stand there as they are: of an item with WORDS of them the
    hash of the first WORDS finds the candidates. A shorter item is looked for
    by its longest word: it is part of some words of the texts' vocabulary, which
    its first SIGNS signs find among all parts of these words, and the texts with
    such a word are candidates. Candidates are then compared whole. Items
    without any word are compared with every text.
    """
    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - WORDS + 1), lambda i: F.xxhash64(F.slice(w, i, WORDS)))
    words = lambda c: F.split(c, r"\s+", -1)
    inner = lambda w: F.slice(w, 2, F.size(w) - 2)
    once = texts.select(key, text).where(F.col(text).isNotNull())
    asked = items.select(item_key, item).where(F.col(item).isNotNull())
    long = asked.where(F.size(words(F.col(item))) >= WORDS + 2)
    by_hash = long.select(item_key, F.xxhash64(F.slice(words(F.col(item)), 2, WORDS)).alias("_h"))
    none = F.array().cast("array<bigint>")
    runs_of = lambda w: F.when(F.size(w) >= WORDS, F.array_distinct(hashes(w))).otherwise(none)
    split_once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))
    inner_words = split_once(words(F.col(text)), lambda w: F.when(F.size(w) >= 2, inner(w)).otherwise(F.array().cast("array<string>")))
    runs = once.select(key, F.explode(split_once(inner_words, runs_of)).alias("_h"))
    pairs = runs.join(by_hash, "_h").select(key, item_key)

    short = asked.where(F.size(words(F.col(item))) < WORDS + 2).withColumn("_words", F.filter(words(F.col(item)), lambda w: w != ""))
    longest = F.array_max(F.transform("_words", lambda w, i: F.struct(F.length(w), (-i).alias("i"), w.alias("w"))))["w"]
    parts = short.where(F.size("_words") > 0).select(item_key, longest.alias("_part")).withColumn("_gram", F.substring("_part", 1, SIGNS))
    in_texts = once.select(key, F.explode(F.array_distinct(words(F.col(text)))).alias("_word"))
    places = F.sequence(F.lit(1), F.length("_word"))
    grams = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.lit(SIGNS)), lambda n: F.substring(F.col("_word"), i, n)))))
    vocabulary = in_texts.select("_word").where("_word <> ''").distinct().select("_word", F.explode(grams).alias("_gram"))
    held = vocabulary.join(parts, "_gram").where(F.contains("_word", "_part")).select("_word", item_key)
    pairs = pairs.union(in_texts.join(held, "_word").select(key, item_key)).distinct()
    found = pairs.join(once, key).join(asked, item_key).where(F.contains(text, item)).select(key, item_key)
    blank = short.where(F.size("_words") == 0).select(item_key, item)
    everywhere = once.join(blank.select(F.col(item).alias("_blank")).distinct(), F.contains(text, "_blank")).join(blank, F.col("_blank") == F.col(item)).select(key, item_key)
    return found.union(everywhere).distinct()
