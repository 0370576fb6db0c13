import random
import re

import numpy as np
import pytest
from conftest import prose

from plumbline.llm.graph import components
from plumbline.llm.near_dedup import keep_one, least_depth, linked, near_duplicates
from plumbline.llm.scratch import Scratch


def brute(texts, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("percent", [80, 85])
def test_same_as_all_pairs(spark, make_docs, percent):
    rng = random.Random(percent)
    texts = {}
    for k in range(40):
        base = prose(rng, 14)
        for j in range(rng.choice([1, 1, 2, 6])):
            texts[len(texts)] = edited(rng, base, rng.choice([0, 1, 2, 3, 5])) if j else base
    texts |= {1000: None, 1001: "", 1002: "Two words", 1003: "two  WORDS", 1004: "two other", 1005: texts[0].upper()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(texts), percent).collect()}
    assert got == brute(texts, percent)


def test_crowded_group_in_blocks(spark, make_docs):
    rng = random.Random(9)
    base = prose(rng, 20)
    texts = {i: edited(rng, base, rng.choice([1, 2, 3])) for i in range(1, 90)} | {500: base} | {i: prose(rng, 5) for i in range(200, 230)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(texts), 85, block=16).collect()}
    assert got == brute(texts, 85)


def test_keep_one(spark, make_docs):
    rng = random.Random(2)
    base = prose(rng, 15)
    docs = make_docs({3: base, 1: edited(rng, base, 1), 2: prose(rng), 4: None})
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [1, 2, 4]


def test_odd_rows(spark, odd_docs):
    got = near_duplicates(odd_docs, 85).collect()
    assert len(got) == 10
    by = {(r.doc_id, r.component_id, r.kept) for r in got}
    assert {(5, 5, True), (12, 5, False), (None, None, False), (7, 7, True), (8, 8, True), (9, 9, True)} <= by
    assert near_duplicates(odd_docs.limit(0), 85).count() == 0
    assert keep_one(odd_docs, 85).columns == odd_docs.columns


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r.node: r.root for r in components(df, Scratch(spark, "t")).collect()}
    assert {r.node: r.root for r in components(df, Scratch(spark, "t"), one_task=0).collect()} == got
    assert components(df.limit(0), Scratch(spark, "t")).collect() == components(df.limit(0), Scratch(spark, "t"), one_task=-1).collect() == []
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {k: v for k, v in root.items() if k != v or list(root.values()).count(v) > 1} == got


def test_linked():
    s = lambda *x: np.array(sorted(x), dtype=np.uint64)
    assert linked([s(1, 2, 3, 4), s(1, 2, 3, 4, 5), s(9), s(2, 3, 4, 5)], 80) == [0, 0, 2, 0]
    assert least_depth(0.85) == 6


def chain(rng, n, words, step):
    """Texts of distinct words; each has all but `step` of its words from the one before."""
    fresh = iter(range(10**9))
    text = [f"w{next(fresh)}" for _ in range(words)]
    out = []
    for _ in range(n):
        out.append(" ".join(text))
        text = text[step:] + [f"w{next(fresh)}" for _ in range(step)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("percent", "words", "step", "crowd", "block"), [(80, 60, 6, 20, 8), (85, 60, 4, 30, 64)])
def test_chains_hold_in_crowded_regions(spark, make_docs, percent, words, step, crowd, block):
    """Neighbours of the chain are just over the threshold; no two others are."""
    texts = chain(random.Random(3), 70, words, step)
    n = words - 4
    assert 100 * (n - step) >= percent * (n + step) and 100 * (n - 2 * step) < percent * (n + 2 * step)
    got = {r.component_id for r in near_duplicates(make_docs(texts), percent, crowd=crowd, block=block).collect()}
    assert got == {0}


@pytest.mark.parametrize("percent", [80])
def test_templates_and_copies_in_crowded_regions_are_all_pairs(spark, make_docs, percent):
    """Texts of one template, most of them under the threshold, some over it, and chains of both."""
    rng = random.Random(percent)
    template = prose(rng, 25).split()
    texts = []
    for k in range(150):
        own = template[:]
        for at in rng.sample(range(0, len(own) - 3, 4), rng.choice([1, 2, 4, 6, 8])):
            own[at] = f"u{rng.randrange(30 if k % 2 else 10**6)}"
        texts.append(" ".join(own))
    texts += chain(rng, 20, 50, 5)
    texts += [edited(rng, t, 1) for t in texts[:20]]
    want = brute(dict(enumerate(texts)), percent)
    for crowd, block in ((30, 8),):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(make_docs(texts), percent, crowd=crowd, block=block).collect()}
        assert got == want
    assert 5 < len({c for _, c in want.values()}) < 250


def test_chained_templates_fall_apart_in_crowded_regions(spark, make_docs):
    """Texts that each share half of their words with the next chain into one region; only the close pairs among them are linked."""
    rng = random.Random(11)
    texts, words = [], [f"w{rng.randrange(10**6)}" for _ in range(60)]
    for k in range(240):
        words = words[6:] + [f"w{rng.randrange(10**6)}" for _ in range(6)]
        texts.append(" ".join(words))
        if k % 3 == 0:
            texts.append(" ".join(words[:-1] + ["changed"]))
    docs = make_docs(texts)
    want = {r.doc_id: r.component_id for r in near_duplicates(docs, 85, crowd=10**9).collect()}
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, 85, crowd=20, block=16).collect()}
    assert got == want and len(set(want.values())) == 240


def test_keep_one_with_clashing_columns(spark):
    text = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, text, 1, 2), (2, text, 3, 4), (3, None, 5, 6)], "doc_id long, text string, gone int, `_gone` int")
    assert sorted(tuple(r) for r in keep_one(df).collect()) == [(1, text, 1, 2), (3, None, 5, 6)]
