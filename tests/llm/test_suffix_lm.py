import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import WORDS
from pyspark.sql import functions as F

from plumbline.llm.scratch import Scratch
from plumbline.llm.suffix_lm import _END, _tokens, fit, score, score_corpus
from plumbline.llm.words import word_hashes


def chain(rng, n):
    """Each word mostly decides the next one."""
    out = [rng.choice(WORDS)]
    for _ in range(n - 1):
        out.append(WORDS[(WORDS.index(out[-1]) * 7 + 3) % len(WORDS)] if rng.random() < 0.8 else rng.choice(WORDS))
    return " ".join(out)


@pytest.fixture
def corpus(make_docs):
    rng = random.Random(7)
    return make_docs([chain(rng, rng.randrange(5, 60)) for _ in range(400)])


def test_base_is_exact_and_contexts_help(spark, corpus):
    learn = F.col("doc_id") % 5 != 1
    got = {r.doc_id: r for r in score_corpus(corpus, learn).collect()}
    texts = {r.doc_id: re.findall(r"\S+", r.text) + [""] for r in corpus.collect()}
    c = Counter(w for i, t in texts.items() if i % 5 != 1 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(w in c for w in t), n)
    held = [i for i in texts if i % 5 == 1]
    assert sum(got[i].score for i in held) > 0.7 * sum(got[i].base_score for i in held)


def test_chances_sum_to_one(spark, corpus):
    tree, _ = fit(corpus, Scratch(spark, "t"))
    assert tree.levels and len(tree.levels[0].contexts)
    words = [*WORDS, "unseen"]
    for context in (["the"], ["stone", "river"], ["of", "and", "to"], []):
        total = 0.0
        for w in words:
            tokens, offsets = _tokens(pa.array([" ".join([*context, w])]))
            _, chance, known, _ = tree.chances(tokens, offsets)
            at = len(context)
            total += 10 ** (chance[at] + (0 if known[at] else tree.root(np.array([0]))[0]))
        tokens, offsets = _tokens(pa.array([" ".join(context)]))
        total += 10 ** tree.chances(tokens, offsets)[1][-1]
        assert total == pytest.approx(1, abs=1e-6)


def test_rare_words_by_join(spark, corpus):
    exact = {r.doc_id: (r.score, r.n_known) for r in score_corpus(corpus, F.lit(True)).collect()}
    scratch = Scratch(spark, "t")
    tree, _ = fit(corpus, scratch, head=0.05, joint=0.05, context=0.05)
    assert len(tree.words) < len(WORDS)
    got = {r.doc_id: (r.base_score, r.n_known) for r in score(corpus, tree, F.lit(True), scratch).collect()}
    assert {i: k for i, (_, k) in got.items()} == {i: k for i, (_, k) in exact.items()}


def test_odd_rows(spark, odd_docs):
    rows = score_corpus(odd_docs, F.col("doc_id").isNotNull()).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert by[7].n_tokens == by[8].n_tokens == by[9].n_tokens == 1 and all(r.score < 0 for r in rows)
    assert score_corpus(odd_docs.limit(0), F.lit(True)).count() == 0
    assert word_hashes(pa.array(["A a"]))[0][0] == word_hashes(pa.array(["A a"]))[0][1] != _END


class Plain:
    """The tree by its definition, from lists of words and dicts of counts; a text's end is "" and its first word follows an end."""

    def __init__(self, texts, depth, cutoff, discount, rare_discount, share):
        flat = Counter(w for t in texts for w in t)
        self.words, self.total = flat, sum(flat.values())
        self.tables: list[dict] = []
        least = max(2, share * self.total)
        contexts = {(w,): n for w, n in flat.items() if n >= least}
        known = {(w,) for w in flat}
        for k in range(1, depth + 1):
            runs: Counter = Counter()
            for t in texts:
                padded = ["", *t]
                for i in range(k, len(padded)):
                    context = tuple(padded[i - k : i])
                    if context in contexts and (*context[1:], padded[i]) in known:
                        runs[(*context, padded[i])] += 1
            runs = Counter({r: n for r, n in runs.items() if n >= 2})
            self.tables.append({c: ({r[-1]: n for r, n in runs.items() if r[:-1] == c}, contexts[c]) for c in {r[:-1] for r in runs}})
            known = set(runs)
            contexts = {r: n for r, n in runs.items() if n >= least and r[-1] != ""}
        self.discount, self.kept = discount, None
        kept: set = set()
        for table in reversed(self.tables):
            shorter = set()
            for c, (nexts, count) in table.items():
                told = sum(nexts.values())
                gain = sum(n * (math.log(self.own(c, x)) - math.log(self.chance(c[1:], x))) for x, n in nexts.items()) + max(count - told, 0) * math.log(self.back(c))
                if gain >= cutoff or c in kept:
                    kept.add(c)
                    shorter.add(c[1:])
            kept |= shorter
        self.kept = kept
        # words too rare for the tree: their next words, by counts less the discount
        self.rare, d = {}, rare_discount
        for w in [w for w, n in flat.items() if n < least]:
            nexts = Counter(b for t in texts for a, b in zip(t, t[1:], strict=False) if a == w)
            total = sum(nexts.values())
            known = sum(self.chance((), x) for x in flat)
            table = {x: known * (n - d) / total + d * len(nexts) / total * self.chance((), x) for x, n in nexts.items()}
            if total and sum(n * math.log(table[x] / self.chance((), x)) for x, n in nexts.items()) >= cutoff:
                self.rare[w] = (table, d * len(nexts) / total)

    def own(self, c, x):
        nexts, count = self.tables[len(c) - 1][c]
        return (nexts[x] - self.discount) / count

    def back(self, c):
        nexts, _ = self.tables[len(c) - 1][c]
        return max(1 - sum(self.own(c, x) for x in nexts), 1e-12) / max(1 - sum(self.chance(c[1:], x) for x in nexts), 1e-12)

    def chance(self, c, x):
        if not c:
            return (self.words[x] + 0.5) / (self.total + 0.5 * (len(self.words) + 1))
        if c not in self.tables[len(c) - 1] or self.kept is not None and c not in self.kept:
            return self.chance(c[1:], x)
        return self.own(c, x) if x in self.tables[len(c) - 1][c][0] else self.back(c) * self.chance(c[1:], x)

    def score(self, words, depth):
        padded = ["", *words]
        return sum(math.log10(self.after(padded[max(0, i - depth) : i], padded[i])) for i in range(1, len(padded)))

    def after(self, before, x):
        if before[-1] in self.rare and x in self.words:
            table, left = self.rare[before[-1]]
            return table.get(x, left * self.chance((), x))
        return self.chance(tuple(before), x)


@pytest.mark.parametrize(("cutoff", "share"), [(0.5, 0.0), (4.0, 0.0), (4.0, 0.047)])
def test_scores_are_those_of_the_plain_tree(spark, corpus, cutoff, share):
    corpus = corpus.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("the "), F.lit("rare"), (F.col("doc_id") / 3).cast("int").cast("string"), F.lit(" "), F.col("text"))).otherwise(F.col("text")))
    rows = {r.doc_id: re.findall(r"\S+", r.text) + [""] for r in corpus.where("doc_id < 120").collect()}
    plain = Plain([t for i, t in rows.items() if i % 5 != 1], 3, cutoff, 0.7, 0.6, share)
    got = {r.doc_id: r.score for r in score_corpus(corpus.where("doc_id < 120"), F.col("doc_id") % 5 != 1, depth=3, cutoff=cutoff, discount=0.7, rare_discount=0.6, context=share, joint=0.0, head=0.0).collect()}
    assert plain.kept and (share or any(len(c) > 1 for c in plain.kept))
    assert bool(plain.rare) == (cutoff < 1 or share > 0)
    for i, t in rows.items():
        assert got[i] == pytest.approx(plain.score(t, 3), abs=1e-6), i
