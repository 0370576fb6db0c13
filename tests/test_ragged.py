import random

import pytest

from plumbline.operators import ragged, tokens


def test_round_trip_and_budget(spark):
    rng = random.Random(3)
    rows = [(i * 7 - 50, [rng.randrange(9) for _ in range(rng.randrange(0, 20))]) for i in range(200)] + [(5000, None), (5001, [])]
    df = spark.createDataFrame(rows, "k long, v array<int>").repartition(4)
    found = ragged.batches(df, "k", "v", 50, width=30)
    assert max(len(r.flat) for r in found.collect()) <= 50
    assert sorted((r.key, r["values"]) for r in ragged.unpacked(found).collect()) == sorted((k, v or []) for k, v in rows)
    order = [s.key for r in found.orderBy("batch").collect() for s in r.spans]
    assert order == sorted(k for k, _ in rows)
    starts = {r.k: r.start for r in ragged.running_starts(df.selectExpr("k", "coalesce(size(v), 0) as n").where("n >= 0"), "k", "n", 30).collect()}
    at = 0
    for k, v in sorted(rows):
        if v is not None:
            assert starts[k] == at
            at += len(v)


def test_a_row_over_the_budget_fails(spark):
    with pytest.raises(Exception, match="longer than the budget"):
        ragged.batches(spark.createDataFrame([(1, [1, 2, 3])], "k long, v array<int>"), "k", "v", 2).collect()
    assert ragged.batches(spark.createDataFrame([], "k long, v array<int>"), "k", "v", 2).collect() == []


def test_frequency_ranks_are_the_plain_ones(spark):
    rng = random.Random(9)
    words = [rng.choice("abcé") * rng.randrange(0, 3) + rng.choice(["", "x", "ß", "𐐀"]) for _ in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "token string")
    counts = {w: words.count(w) for w in words}
    order = sorted(counts, key=lambda w: (-counts[w], w))
    for prefix in (1, 3):
        got = {r.token: (r.n, r["rank"]) for r in tokens.frequency_ranks(df, prefix=prefix).collect()}
        assert got == {w: (counts[w], pytest.approx(1 - i / len(order))) for i, w in enumerate(order)}
