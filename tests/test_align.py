import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import align


def overlaps(a, b):
    """Which pieces of b share a sign with each piece of a, within the longest common run of the joined texts: sign by sign."""
    owner = lambda pieces: [k for k, piece in enumerate(pieces) for _ in "".join(piece.split())]
    left, right = ("".join("".join(p.split()) for p in x) for x in (a, b))
    i, j, n = common(left, right)
    pairs = set(zip(owner(a)[i : i + n], owner(b)[j : j + n], strict=True)) if n else set()
    return [sorted({y for x, y in pairs if x == k}) for k in range(len(a))]


def common(a, b):
    best = (-1, -1, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[2]:
                best = (i, j, n)
    return best


def cut(rng, text):
    at = sorted(rng.sample(range(1, len(text)), rng.randrange(1, min(9, len(text)))))
    return [text[i:j] for i, j in zip([0, *at], [*at, len(text)], strict=True)]


@pytest.fixture(scope="module")
def pairs():
    rng, out = random.Random(5), []
    for k in range(24):
        text = "".join(rng.choice(["ab", "c ", "éß", "鐵", "x\n", " ", "q"]) for _ in range(40)) + "z"
        other = text if k % 3 else text[5:20] + "ÄÖ" + text[24:]
        out.append((cut(rng, text), cut(rng, other)))
    return out + [(["go", "go", "go"], ["gogo", "go"]), (["stone", "bridge"], ["qqq", "stone", "bridge"]), (["abc"], ["xyz"]), ([" ", "lamp"], ["lamp"])]


@pytest.mark.parametrize("width", [3, 256])
def test_aligned_tokens_sign_by_sign(spark, pairs, width):
    rows = lambda side: spark.createDataFrame([(k, i, t) for k, p in enumerate(pairs) for i, t in enumerate(p[side])], "k int, pos int, token string")
    got = {(r.k, r.pos): r.matches for r in align.aligned_tokens(rows(0), rows(1), "k", width=width).collect()}
    assert got == {(k, i): m for k, (a, b) in enumerate(pairs) for i, m in enumerate(overlaps(a, b))}


def test_a_text_without_the_other_side_matches_nothing(spark):
    a = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "k int, pos int, token string")
    got = {(r.k, r.pos): r.matches for r in align.aligned_tokens(a, a.where("k = 1"), "k").collect()}
    assert got == {(1, 0): [0], (2, 0): []}


def test_longest_common_run_of_signs_and_of_words(spark):
    rng = random.Random(3)
    texts = [("".join(rng.choice("ab") for _ in range(rng.randrange(0, 30))), "".join(rng.choice("abc") for _ in range(rng.randrange(0, 30)))) for _ in range(120)]
    texts += [("same text", "same text"), ("", "x"), ("x", ""), ("𐐀b", "b𐐀"), ("aaaa", "aa")]
    df = spark.createDataFrame(texts, "a string, b string")
    got = [tuple(r) for r in df.select(align.longest_common_text("a", "b").alias("r")).select("r.*").collect()]
    assert got == [common(a, b) for a, b in texts]
    long_a, long_b = (np.array([rng.randrange(50) for _ in range(3000)]) for _ in range(2))
    at = SequenceMatcher(None, long_a.tolist(), long_b.tolist(), autojunk=False).find_longest_match()
    assert align.longest_common(long_a, long_b) == (at.a, at.b, at.size)


def test_array_means_and_runs(spark):
    df = spark.createDataFrame([("k", [1.0, 3.0], [2.0]), ("k", [3.0], [4.0]), ("m", [], None)], "k string, a array<double>, b array<double>")
    got = {r.k: (r.a, r.b) for r in align.array_means(df, "k", ["a", "b"]).collect()}
    assert got == {"k": ([2.0, 3.0], [3.0])}
    rows = spark.createDataFrame([(["x", "a", "b", "a", "b"], ["a", "b"]), (["a"], ["a", "b"]), ([], [])], "t array<string>, r array<string>")
    assert [r[0] for r in rows.select(align.first_run(F.col("t"), F.col("r"))).collect()] == [1, None, 0]


def test_containing_is_the_nested_loop(spark):
    rng = random.Random(2)
    words = "stone river lamp green paper north engine".split()
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(99, None)]
    items = [(i, (lambda t: t[len(t) // 3 : 2 * len(t) // 3])(texts[rng.randrange(60)][1])) for i in range(25)] + [(50, "lamp"), (51, None), (52, "none of these words at all stand there")]
    items += [(60, "am"), (61, "e"), (62, "mp ston"), (63, " "), (64, ""), (65, "n e"), (66, "north engine pa"), (67, "iver  lamp"), (68, "lamp "), (69, " green"), (50, "lamp"), (70, "rth"), (71, "  ")]
    texts += [(100, "a  b"), (101, ""), (102, "river\nlamp")]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item string")
    got = {tuple(r) for r in align.containing(d, b, "doc_id", "text", "item_id", "item").collect()}
    assert got == {(i, k) for i, t in texts for k, x in items if t is not None and x is not None and x in t}


def test_lists_without_exchange(spark):
    """Places, spans and matches told row by row are those of the joins, and no row of a token is exchanged."""
    texts = spark.createDataFrame([(1, ["ab", "é\U0001f600c", "d"], ["abé", "\U0001f600", "", "cd"]), (2, ["xx", "", "abc"], ["abc"]), (3, ["a"], ["b"])], "k int, a array<string>, b array<string>")
    rows = lambda c: texts.select("k", F.posexplode(c).alias("pos", "token"))
    want = {(r.k, r.pos): list(r.matches) for r in align.aligned_tokens(rows("a"), rows("b"), "k").collect()}
    found = texts.select("k", align.matched("a", "b").alias("m"))
    got = {(r.k, i): (f, n) for r in found.collect() for i, (f, n) in enumerate(zip(r.m.first, r.m.n, strict=True))}
    assert got == {at: (m[0] if m else -1, len(m)) for at, m in want.items()}
    held = texts.select("k", align.holding(F.col("a"), F.lit(1), F.lit(4)).alias("h"))
    assert {(r.k, r.h.first, r.h.last) for r in held.collect()} == {(1, 0, 1), (2, 0, 2), (3, None, None)}
    placed = align.spans(rows("a"), "k", "pos", "token")
    every = align.at_every(placed, "k", "pos", 2)
    assert {(r.k, r.place, r.pos, r.start) for r in every.collect()} == {(1, 0, 0, 0), (1, 2, 1, 2), (1, 4, 1, 2), (2, 0, 0, 0), (2, 2, 2, 2), (2, 4, 2, 2), (3, 0, 0, 0)}
    for plan in (found, held):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
