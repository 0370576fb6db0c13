import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import spelling
from plumbline.llm.scratch import Scratch


def plain_vocabulary(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def plain_variants(rows, times=5):
    words = plain_vocabulary(rows)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), form[w] and words[form[w]]) for w, n in words.items()), key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def corpus(rng):
    base = ["winter", "glasses", "élèves", "Straße", "bookkeeper", "committee", "aaaaaa"]
    weights, words = {}, []
    for w in base:
        a, b = rng.sample(range(len(w)), 2)
        for v, n in ((w, 160), (w[:a] + w[a + 1 :], 25), (w[:b] + "x" + w[b:], 30), (w[:a] + "q" + w[a + 1 :], 5), (w[:a] + "q" + w[a + 1 :] + "s", 6), (w + w[-1], 7)):
            weights[v] = max(n, weights.get(v, 0))
    for v, n in weights.items():
        words += [v] * n
    rng.shuffle(words)
    texts = [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)]
    return list(enumerate(texts)) + [(3, texts[3]), (None, texts[0]), (900, None), (901, ""), (902, "12 34 ×÷× WINTER-Winter_winter")]


def test_whole_against_plain_loops(spark):
    rows = corpus(random.Random(1))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as word", "doc_id as n", "text as run")
    got = found(spelling.variants(spark, df))
    assert got == plain_variants(rows)
    assert sum(r[1] is not None for r in got) > 8


def test_chains_of_forms(spark):
    rows = [(1, " ".join(["abcdef"] * 5 + ["abcdeg"] * 25 + ["abcdhg"] * 125 + ["abidhg"] * 625 + ["zbidhg"] * 3125))]
    got = {r[0]: r[2] for r in found(spelling.variants(spark, spark.createDataFrame(rows, "doc_id long, text string")))}
    assert set(got.values()) == {"zbidhg"} and found(spelling.variants(spark, spark.createDataFrame(rows, "doc_id long, text string"))) == plain_variants(rows)


def test_empty_table(spark):
    assert spelling.variants(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def plain_neighbourhood(word, alphabet):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in alphabet if c != word[i]}
    return out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in alphabet}


@pytest.mark.parametrize("block", [1 << 20, 7])
def test_neighbourhood_is_whole_and_distinct(monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    words = ["aab", "abcabc", "éaé", "bbbbbbbb", "x", "abcabd"]
    made = list(spelling.neighbourhood(words, "abcxé"))
    assert len(made) == len(set(made))
    for i, w in enumerate(words):
        assert {s for k, s in made if k == i} == plain_neighbourhood(w, "abcxé")


def test_filter_lets_all_words_through(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(rng.randrange(6, 9))) for _ in range(300)} | {"a" * 3000})
    df = Scratch(spark, "test-words").keep(spark.createDataFrame([(w,) for w in words], "word string"))
    lanes, bits = spelling.word_filter(df, len(words))
    got = set(spelling.neighbourhood(words, "abcdé", lanes, bits))
    whole = {(i, s) for i, w in enumerate(words) if len(w) < 20 for s in plain_neighbourhood(w, "abcdé")}
    known = set(words)
    assert {(i, s) for i, s in whole if s in known} <= got
    assert len({x for x in got if len(words[x[0]]) < 20} - {(i, s) for i, s in whole if s in known}) < len(whole) / 50  # and few others
    assert lanes.dtype == np.uint64 and {(i, s) for i, s in got if len(words[i]) < 20} <= whole
