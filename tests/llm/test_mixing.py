import math
import random

import pytest
from conftest import prose
from pyspark.sql import functions as F

from plumbline.llm.mixing import mix, token_count, weights


@pytest.fixture
def uneven(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, 6), "big" if i < 600 else f"s{i % 4}") for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def shares(df):
    got = {r.source: r.t for r in df.groupBy("source").agg(F.sum("_tokens").alias("t")).collect()}
    return {s: t / sum(got.values()) for s, t in got.items()}


def entropy(w):
    return -sum(x * math.log(x) for x in w if x > 0)


def sources(df):
    return df.groupBy("source").agg(F.sum(token_count(F.col("text"))).alias("tokens"))


def test_entropy_is_met(uneven):
    w = [r.weight for r in weights(sources(uneven), entropy=0.9).collect()]
    assert sum(w) == pytest.approx(1) and entropy(w) == pytest.approx(0.9 * math.log(5), abs=1e-4)
    got = shares(mix(uneven, entropy=0.9, block_tokens=2000))
    want = {r.source: r.weight for r in weights(sources(uneven), entropy=0.9).collect()}
    assert all(abs(got[s] - want[s]) < 0.01 for s in want)


def test_repetition_limit_is_met(uneven):
    rows = weights(sources(uneven), repetition=1.5).collect()
    total = sum(r.tokens for r in rows)
    assert max(r.weight * total / r.tokens for r in rows) == pytest.approx(1.5, abs=1e-3)


def test_cover_keeps_all(uneven):
    out = mix(uneven, repetition=1.5, cover=True, block_tokens=2000)
    assert out.select("doc_id").distinct().count() == 900
    per = out.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("m"), F.min("count").alias("n")).collect()
    assert all(r.n >= 1 and r.m - r.n <= 1 and r.m <= 2 for r in per)
    assert 900 < out.count() < 1.5 * 900


def test_same_every_time(uneven):
    rows = lambda df: sorted(map(tuple, mix(df, entropy=0.8, block_tokens=2000).select("doc_id", "_epoch", "_block", "_order").collect()))
    assert rows(uneven) == rows(uneven.repartition(7))


def test_odd_rows(spark, odd_docs):
    out = mix(odd_docs, repetition=2.0, cover=True)
    assert out.count() >= 10 and out.where("doc_id = 2 and source is null").count() >= 1
    assert mix(odd_docs.limit(0)).count() == 0


def test_epochs_blocks_and_cuts_by_plain_loops(uneven):
    """Each source's blocks, epochs and cut block, from the hashes that order them."""
    out = mix(uneven, entropy=0.9, block_tokens=700).collect()
    plan = {r.source: r for r in weights(sources(uneven), entropy=0.9).collect()}
    total = sum(r.tokens for r in plan.values())
    key = F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64("text"), F.lit(42))
    docs = uneven.select("doc_id", "source", key.alias("key"), token_count(F.col("text")).alias("t")).collect()
    turns = uneven.sparkSession.range(0, 400).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("e"))
    want = {}
    for source, row in plan.items():
        n = max(1, math.ceil(row.tokens / 700))
        turn = {(r.b, r.e): r.h for r in turns.where(F.col("b") < n).select("b", "e", F.pmod(F.xxhash64(F.lit(source), F.col("b").cast("int"), F.col("e").cast("int"), F.lit(42)), F.lit(1 << 30)).alias("h")).collect()}
        mine = [d for d in docs if d.source == source]
        take = row.weight * total
        epochs = int(take / row.tokens + 1e-9)
        left = max(0.0, take - epochs * row.tokens)
        copies = {d.doc_id: epochs for d in mine}
        for b in sorted(range(n), key=lambda b: (turn[b, epochs], b)):
            block = sorted((d for d in mine if d.key % n == b), key=lambda d: d.key)
            size = sum(d.t for d in block)
            room, left = left, left - size
            used = 0
            for d in block:
                used += d.t
                if room > 0 and (size <= room or used <= room):
                    copies[d.doc_id] += 1
        for d in mine:
            for e in range(copies[d.doc_id]):
                at = (e + (turn[d.key % n, e] + d.key % (1 << 30) / (1 << 30)) / (1 << 30)) * row.tokens / take
                want[d.doc_id, e] = (d.key % n, at)
    got = {(r.doc_id, r._epoch): (r._block, r._order) for r in out}
    assert got.keys() == want.keys() and len(got) == len(out)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in got)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two", "a", 7, "x"), (2, "three", "b", 8, "y")], "doc_id long, text string, source string, _epoch int, _source string")
    out = mix(df, repetition=1.0)
    assert out.columns == ["doc_id", "text", "source", "_epoch_in", "_source", "_tokens", "_weight", "_epoch", "_block", "_order"]
    assert {(r.doc_id, r._epoch_in, r._source) for r in out.collect()} <= {(1, 7, "x"), (2, 8, "y")}
