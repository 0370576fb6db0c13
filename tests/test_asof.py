import random

from plumbline.operators import asof


def test_asof_is_the_nested_loop(spark):
    rng = random.Random(4)
    left = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(0, 200, 7)]), i) for i in range(150)]
    right = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(0, 200, 9)]), i % 40, f"v{i}") for i in range(90)] + [("hot", 50, 99, "last"), ("hot", 50, 98, "x")]
    ldf, rdf = spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, t long, tie long, v string")

    def want(k, t):
        fit = [(rt, tie, v) for rk, rt, tie, v in right if rk is not None and rk == k and t is not None and rt is not None and rt <= t]
        return max(fit)[2] if fit else None

    for width in (1, 10, 1000):
        got = sorted((r.i, r.v) for r in asof.asof(ldf, rdf, ["k"], "t", ["v"], width, ["tie", "v"]).collect())
        assert got == sorted((i, want(k, t)) for k, t, i in left)


def test_asof_of_empty_sides(spark):
    ldf, rdf = spark.createDataFrame([(1, 2)], "k int, t int"), spark.createDataFrame([], "k int, t int, v string")
    assert [tuple(r) for r in asof.asof(ldf, rdf, ["k"], "t", ["v"], 10).collect()] == [(1, 2, None)]
    assert asof.asof(ldf.limit(0), rdf, ["k"], "t", ["v"], 10).collect() == []


def test_overlaps_is_the_nested_loop(spark):
    rng = random.Random(8)
    make = lambda n: [(rng.choice("ab"), i, (s := rng.randrange(0, 90)), s + rng.randrange(0, 25)) for i in range(n)]
    a, b = make(60), make(60)
    adf, bdf = (spark.createDataFrame(x, "k string, i int, start int, end int") for x in (a, b))
    want = sorted((i, j) for k, i, s, e in a for q, j, x, y in b if k == q and max(s, x) < min(e, y))
    for width in (1, 7, 500):
        assert sorted((r.i, r.b_i) for r in asof.overlaps(adf, bdf, "k", width).collect()) == want
