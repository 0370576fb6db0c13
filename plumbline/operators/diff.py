"""Differences of two sequences (lines, words, signs) of a row, for sequences of any length.

Every pair, of whatever length, is compared in its row: it gets a longest
common subsequence, worked out with one machine word for 64 cells. Time is the
product of the lengths by 64. Memory is the square root of the rows: of large
pairs some rows are kept, the others made again.

Rows of tables are compared by 64-bit hashes of their elements. A null sequence
counts as empty. Of several longest common subsequences the one with the last
places is taken, so that what is equal stands together.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from difflib import SequenceMatcher
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells up to which a replaced stretch of a text is counted in its pair's row.
EXACT = 1 << 22

RUNS = T.ArrayType(T.StructType([T.StructField(c, T.IntegerType()) for c in "ijn"]))
COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in ("matched", "changed")])
SWAPPED = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in "xy"]))
PAIR_COUNTS = T.StructType([*COUNTS.fields, T.StructField("rest", SWAPPED)])


# --- helpers on one row's sequences ---


def longest_chain(places: Sequence[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tops: list[int] = []
    tails: list[int] = []
    before = [-1] * len(places)
    for k, x in enumerate(places):
        at = bisect_left(tails, x)
        if at:
            before[k] = tops[at - 1]
        if at == len(tails):
            tails.append(x)
            tops.append(k)
        else:
            tails[at], tops[at] = x, k
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


#: Cells up to which all rows of bits are held at once (4 MB), and bytes of masks that are held; others are made for each row.
HELD, MASKS = 1 << 25, 1 << 26


def common_runs(a: Sequence, b: Sequence, held: int = HELD, masks: int = MASKS) -> list[tuple[int, int, int]]:
    """Runs (i, j, n) of equal elements that make up a longest common subsequence; it doesn't depend on held and masks."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    matches = _matches(a[head : len(a) - tail], b[head : len(b) - tail], held, masks)
    runs = [[0, 0, head]] if head else []
    for i, j in matches:
        i, j = head + i, head + j
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
            runs[-1][2] += 1
        else:
            runs.append([i, j, 1])
    if tail:
        i, j = len(a) - tail, len(b) - tail
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
            runs[-1][2] += tail
        else:
            runs.append([i, j, tail])
    return [tuple(r) for r in runs]


def _mask(places: list[int], size: int) -> int:
    """Bits at the places, of less than 8 * size."""
    if len(places) < 8:
        return sum(1 << j for j in places)
    bits = bytearray(size)
    for j in places:
        bits[j >> 3] |= 1 << (j & 7)
    return int.from_bytes(bits, "little")


def _masks(b: Sequence, most: int) -> dict:
    """The places of each element of b as bits; beyond `most` bytes of bits those of the rarer ones as lists."""
    found: dict = {}
    if len(b) <= 512:
        for j, x in enumerate(b):
            found[x] = found.get(x, 0) | 1 << j
        return found
    for j, x in enumerate(b):
        found.setdefault(x, []).append(j)
    size = len(b) // 8 + 1
    common = found if len(found) * size <= most else sorted(found, key=lambda x: -len(found[x]))[: most // size]
    for x in common:
        found[x] = _mask(found[x], size)
    return found


def _matches(a: Sequence, b: Sequence, held: int = HELD, most: int = MASKS) -> list[tuple[int, int]]:
    """Bit j of row i is 0 where b[j] makes the longest common subsequence with a[:i] longer; of many cells some rows are kept, the others made again."""
    if not len(a) or not len(b):
        return []
    if len(b) > 512:  # what a lacks keeps its bit in all rows
        there = set(a)
        at = [j for j, x in enumerate(b) if x in there]
        if len(at) < len(b):
            return [(i, at[j]) for i, j in _matches(a, [b[j] for j in at], held, most)]
    masks, size = _masks(b, most), len(b) // 8 + 1
    full = (1 << len(b)) - 1
    step = len(a) if len(a) * len(b) <= held else max(1, int(len(a) ** 0.5))

    def rows(start: int, stop: int, row: int) -> list[int]:
        made = []
        for x in a[start:stop]:
            if x in masks:
                mask = masks[x]
                hit = row & (mask if type(mask) is int else _mask(mask, size))
                if hit:
                    row = ((row + hit) | (row - hit)) & full
            made.append(row)
        return made

    kept = [full]
    for start in range(0, len(a) - step, step):
        kept.append(rows(start, start + step, kept[-1])[-1])
    out, j = [], len(b)
    for block in range(len(kept) - 1, -1, -1):
        start = block * step
        made = rows(start, start + step, kept[block])
        i = start + len(made)
        while i > start and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.append((i, j))
            elif made[i - 1 - start] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
    return out[::-1]


def matcher_runs(a: Sequence, b: Sequence) -> list[tuple[int, int, int]]:
    """Runs by the longest block first, with difflib's default treatment of very common elements."""
    return [(m.a, m.b, m.size) for m in SequenceMatcher(None, a, b).get_matching_blocks() if m.size]


RULES = {"subsequence": common_runs, "blocks": matcher_runs}


def _runs_udf(rule: str, held: int):
    find = (lambda a, b: common_runs(a, b, held)) if rule == "subsequence" else RULES[rule]

    @F.pandas_udf(RUNS)
    def runs(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"i": i, "j": j, "n": n} for i, j, n in find(x.tolist(), y.tolist())] for x, y in zip(a, b, strict=True)], dtype=object)

    return runs


# --- over tables ---


def hashed(elements: Column) -> Column:
    return F.transform(F.coalesce(elements, F.array().cast("array<string>")), lambda x: F.xxhash64(x))


def with_runs(pairs: DataFrame, key: str, base: str, other: str, rule: str = "subsequence", held: int = HELD) -> DataFrame:
    """pairs (one row a key) with a column runs: the equal runs (i, j, n) of the arrays base and other, by place.

    rule: what compares a pair; "blocks" takes the longest block first and
    passes over very common elements, as difflib does. Pairs are compared the
    same way whatever their size; held: cells up to which a pair's rows are held.
    """
    return pairs.withColumn("runs", _runs_udf(rule, held)(hashed(F.col(base)), hashed(F.col(other))))


# --- what the runs say, as column expressions ---


def opcodes(runs: Column, n: Column, m: Column) -> Column:
    """The steps from base (n elements) to other (m): structs tag (equal, replace, delete, insert), i1, i2, j1, j2 in order."""
    one = lambda i, j, k: F.array(F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(k).alias("n")))
    starts, ends = F.concat(one(F.lit(0), F.lit(0), 0), runs), F.concat(runs, one(n, m, 0))

    def steps(s: Column, e: Column) -> Column:
        i, j = s["i"] + s["n"], s["j"] + s["n"]
        tag = F.when(e["i"] == i, "insert").when(e["j"] == j, "delete").otherwise("replace")
        return F.array(_step(tag, i, e["i"], j, e["j"]), _step(F.lit("equal"), e["i"], e["i"] + e["n"], e["j"], e["j"] + e["n"]))

    return F.filter(F.flatten(F.zip_with(starts, ends, steps)), lambda o: (o["i2"] > o["i1"]) | (o["j2"] > o["j1"]))


def _step(tag: Column, i1: Column, i2: Column, j1: Column, j2: Column) -> Column:
    return F.struct(tag.alias("tag"), i1.alias("i1"), i2.alias("i2"), j1.alias("j1"), j2.alias("j2"))


_NO_STEP = "struct<tag:string,i1:int,i2:int,j1:int,j2:int>"


def kept(ops: Column, inserts: bool = True) -> Column:
    """For each element of base 1 if it stays, else 0; with inserts also 0 where something new stands right before it."""
    before = F.concat(F.array(F.lit(None).cast(_NO_STEP)), ops)

    def flags(p: Column, o: Column) -> Column:
        size = o["i2"] - o["i1"]
        plain = F.array_repeat((o["tag"] == "equal").cast("int"), size)
        after_new = F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(1), size - 1))
        out = F.when((o["tag"] == "equal") & (p["tag"] == "insert"), after_new).otherwise(plain) if inserts else plain
        return F.when(o.isNotNull(), out).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.zip_with(before, ops, flags))


def token_rows(df: DataFrame, keys: list[str], base: str, other: str, ops: str = "ops", logprobs: str | None = None, closed: Sequence[str] = ()) -> DataFrame:
    """A row for each token of either side: keys, token, tag, equal, old_idx (null for new ones), new_idx (null for removed ones).

    With logprobs (an array beside base) also logprob and prob of old tokens,
    and whether the token is in the closed vocabulary.
    """
    made = lambda t, o, i, j: F.struct(t.alias("token"), o["tag"].alias("tag"), (o["tag"] == "equal").alias("equal"), i.alias("old_idx"), j.alias("new_idx"))
    null = F.lit(None).cast("int")

    def rows(o: Column) -> Column:
        old = F.transform(F.slice(base, o["i1"] + 1, o["i2"] - o["i1"]), lambda t, q: made(t, o, o["i1"] + q, F.when(o["tag"] == "equal", o["j1"] + q)))
        new = F.transform(F.when(o["tag"] != "equal", F.slice(other, o["j1"] + 1, o["j2"] - o["j1"])).otherwise(F.array().cast("array<string>")), lambda t, q: made(t, o, null, o["j1"] + q))
        return F.concat(old, new)

    if logprobs is None:
        return df.select(*keys, F.explode(F.flatten(F.transform(ops, rows))).alias("_r")).select(*keys, "_r.*")
    with_probs = F.transform(F.flatten(F.transform(ops, rows)), lambda r: F.struct(r.alias("r"), F.get(logprobs, r["old_idx"]).alias("logprob")))
    out = df.select(*keys, F.explode(with_probs).alias("_r")).select(*keys, "_r.r.*", "_r.logprob")
    return out.select("*", F.exp("logprob").alias("prob"), F.col("token").isin(list(closed)).alias("closed"))


def lines(text: Column) -> Column:
    """The lines of a text, without those that are empty at its beginning, and none behind its last line break."""
    found = F.split(F.regexp_replace(text, r"^\n+", ""), r"\r\n|\n|\r", -1)
    ended = lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x)
    return F.get(F.transform(F.array(found), ended), F.lit(0))  # split once


def squeezed(found: Column) -> Column:
    """Lines without white space at their ends and without spaces."""
    return F.transform(found, lambda x: F.replace(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit(" "), F.lit("")))


def line_edit(ops: Column, base: Column, other: Column) -> Column:
    """Struct of arrays of 0.0 and 1.0: rewrites and deletes for each line of base, insert_before for each place between lines.

    Lines that others replace are rewritten; those over on base's side are
    deleted, those over on the other's are inserted behind. Removing or adding
    nothing but comments, and adding nothing but blank lines, counts for nothing.
    """
    comments = lambda part: F.forall(part, lambda x: x.startswith("#"))
    here = lambda o: F.slice(base, o["i1"] + 1, o["i2"] - o["i1"])
    there = lambda o: F.slice(other, o["j1"] + 1, o["j2"] - o["j1"])
    repeat = lambda v, k: F.array_repeat(F.lit(float(v)), k)

    def rewrites(o: Column) -> Column:
        size, changed = o["i2"] - o["i1"], F.when(o["tag"] == "replace", F.least(o["i2"] - o["i1"], o["j2"] - o["j1"])).otherwise(0)
        return F.concat(repeat(1, changed), repeat(0, size - changed))

    def deletes(o: Column) -> Column:
        size = o["i2"] - o["i1"]
        gone = F.when(o["tag"] == "replace", F.greatest(size - (o["j2"] - o["j1"]), F.lit(0))).when((o["tag"] == "delete") & ~comments(here(o)), size).otherwise(0)
        return F.concat(repeat(0, size - gone), repeat(1, gone))

    def adds(o: Column) -> Column:
        more = (o["tag"] == "replace") & (o["j2"] - o["j1"] > o["i2"] - o["i1"])
        new = (o["tag"] == "insert") & ~comments(there(o)) & F.exists(there(o), lambda x: x != "")
        return F.coalesce(more | new, F.lit(False))

    def behind(o: Column, following: Column) -> Column:
        """A flag for the place behind each of the step's lines."""
        size = o["i2"] - o["i1"]
        last = adds(o) | F.coalesce((following["tag"] == "insert") & adds(following), F.lit(False))
        flags = F.concat(repeat(0, size - 1), F.array(last.cast("double")))
        return F.when(o.isNotNull() & (size > 0), flags).otherwise(F.array().cast("array<double>"))

    first = F.get(ops, F.lit(0))
    at_start = F.coalesce((first["tag"] == "insert") & adds(first), F.lit(False)).cast("double")
    following = F.concat(F.when(F.size(ops) > 0, F.slice(ops, 2, F.size(ops))).otherwise(ops), F.array(F.lit(None).cast(_NO_STEP)))
    inserts = F.concat(F.array(at_start), F.flatten(F.zip_with(ops, following, behind)))
    return F.struct(F.flatten(F.transform(ops, rewrites)).alias("rewrites"), F.flatten(F.transform(ops, deletes)).alias("deletes"), inserts.alias("insert_before"))


# --- distances of texts ---

PIECES = r"\w+|\s+|[^\w\s]"


def _run_counts(x: str, y: str) -> tuple[int, int]:
    i = j = matched = changed = 0
    for p, q, n in [*common_runs(x, y), (len(x), len(y), 0)]:
        changed += max(p - i, q - j)
        matched += n
        i, j = p + n, q + n
    return matched, changed


def _counts(x: str, y: str) -> tuple[int, int]:
    """Signs that stay, and signs removed or added, of replaced ones the larger number: _run_counts, for words without their runs being made."""
    if len(x) > 512 or len(y) > 512:
        return _run_counts(x, y)
    head, i, j = 0, len(x), len(y)
    while head < i and head < j and x[head] == y[head]:
        head += 1
    while i > head and j > head and x[i - 1] == y[j - 1]:
        i, j = i - 1, j - 1
    matched, changed, after, behind = head + len(x) - i, 0, i, j
    if i > head and j > head:
        masks: dict = {}
        bit = full = 1
        for c in y[head:j]:
            masks[c] = masks.get(c, 0) | bit
            bit <<= 1
        full = row = bit - 1
        made = []
        for c in x[head:i]:
            if c in masks:
                hit = row & masks[c]
                row = ((row + hit) | (row - hit)) & full
            made.append(row)
        bit >>= 1
        while bit and i > head:
            if x[i - 1] == y[j - 1]:
                changed += max(after - i, behind - j)
                i, j, bit = i - 1, j - 1, bit >> 1
                after, behind, matched = i, j, matched + 1
            elif made[i - 1 - head] & bit:
                j, bit = j - 1, bit >> 1
            else:
                i -= 1
    return matched, changed + max(after - head, behind - head)


@F.pandas_udf(COUNTS)
def _sign_counts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_counts(x, y) if x is not None and y is not None else (0, 0) for x, y in zip(a, b, strict=True)], columns=["matched", "changed"])


def _pair_counts(x: str, m: Sequence[int], y: str, n: Sequence[int], exact: int) -> tuple[int, int, list[dict]]:
    """matched and changed of two texts with the sizes of their pieces; rest: replaced stretches of more than `exact` cells, which aren't counted yet."""
    at, bt = [0, *accumulate(m)], [0, *accumulate(n)]
    a, b = ([t[p:q] for p, q in zip(c, c[1:])] for t, c in ((x, at), (y, bt)))
    i = j = matched = changed = 0
    rest = []
    for p, q, k in [*common_runs(a, b), (len(a), len(b), 0)]:
        old, new = x[at[i] : at[p]], y[bt[j] : bt[q]]
        if not old or not new:
            changed += len(old) + len(new)
        elif len(old) * len(new) > exact:
            rest.append({"x": old, "y": new})
        else:
            same, other = _counts(old, new)
            matched, changed = matched + same, changed + other
        i, j = p + k, q + k
        matched += at[i] - at[p]
    return matched, changed, rest


def _pair_counts_udf(exact: int):
    @F.pandas_udf(PAIR_COUNTS)
    def counts(x: pd.Series, m: pd.Series, y: pd.Series, n: pd.Series) -> pd.DataFrame:
        known = lambda t, s: (t, s.tolist()) if t is not None else ("", [])
        return pd.DataFrame([_pair_counts(*known(a, c), *known(b, d), exact) for a, c, b, d in zip(x, m, y, n, strict=True)], columns=["matched", "changed", "rest"])

    return counts


def pieces(text: Column) -> Column:
    """A text with the sizes of its words and of what stands between them: a fraction of the room that the pieces themselves take."""
    return F.struct(text.alias("text"), F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda x: F.length(x)).alias("sizes"))


def sign_distance(pairs: DataFrame, key: str, a: str, b: str, exact: int = EXACT) -> DataFrame:
    """(key, ratio, distance) of two texts: twice the signs that stay over all signs (1 for two empty texts), and the signs removed or added, of replaced ones the larger number.

    Words and what stands between them are compared first; signs only where
    words replace others, in the pair's row up to `exact` cells of a stretch;
    larger stretches are dealt out. Texts of null give nulls. Keys are distinct.
    """
    return piece_distance(pairs.select(key, pieces(F.col(a)).alias("_x"), pieces(F.col(b)).alias("_y")), key, exact)


def piece_distance(rows: DataFrame, key: str, exact: int = EXACT) -> DataFrame:
    """sign_distance of rows with the texts and the sizes of their pieces, _x and _y."""
    signs = F.length("_x.text") + F.length("_y.text")
    counted = rows.select(key, signs.alias("_signs"), _pair_counts_udf(exact)("_x.text", "_x.sizes", "_y.text", "_y.sizes").alias("c"))
    parts = counted.select(key, "_signs", "c.matched", "c.changed", F.posexplode_outer("c.rest").alias("_at", "_p"))
    own = lambda c: F.when(F.coalesce("_at", F.lit(0)) == 0, F.col(c)).otherwise(0)
    parts = parts.select(key, "_signs", own("matched").alias("matched"), own("changed").alias("changed"), F.col("_p.x").alias("x"), F.col("_p.y").alias("y"))
    dealt = parts.repartition(F.col(key), F.xxhash64("x", "y")).select(key, "_signs", "matched", "changed", _sign_counts("x", "y").alias("c"))
    sums = dealt.groupBy(key).agg(F.max("_signs").alias("_signs"), F.sum(F.col("matched") + F.col("c.matched")).alias("matched"), F.sum(F.col("changed") + F.col("c.changed")).alias("changed"))
    ratio = F.when(F.col("_signs") == 0, 1.0).when(F.col("_signs") > 0, 2.0 * F.col("matched") / F.col("_signs"))
    return sums.select(key, ratio.alias("ratio"), F.when(F.col("_signs").isNotNull(), F.col("changed").cast("double")).alias("distance"))


def mean_ratio(samples: DataFrame, group: str, key: str, a: str, b: str) -> DataFrame:
    """(group, n, ratio): the mean ratio of each group's pairs; key numbers all pairs."""
    found = sign_distance(samples.select(key, a, b), key, a, b)
    return samples.select(group, key).join(found, key).groupBy(group).agg(F.count("ratio").alias("n"), F.avg("ratio").alias("ratio"))
