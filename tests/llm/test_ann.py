import numpy as np
from pyspark.sql import functions as F

from plumbline.llm.additive_ann import Codebooks, nearest, train

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(ids, x, query, k):
    i = ids.index(query)
    score = x @ x[i]
    order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
    return [(ids[j], score[j]) for j in order]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32).astype(float)
    ids = list(range(3000))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], SCHEMA)
    got = nearest(df, F.col("id") % 100 == 0, k=10, books=8, words=32, sample=1500, shortlist=120, block=700, queries_block=8).collect()
    hits = 0
    for q in range(0, 3000, 100):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11))
        for _, v, s in mine:
            assert abs(s - x[v] @ x[q]) < 1e-9
        hits += len({m[1] for m in mine} & {v for v, _ in exact(ids, x, q, 10)})
    assert hits >= 0.9 * 300


def test_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 2.0], 1) for i in range(40)] + [(100 + i, [float(i), 1.0], 1) for i in range(5)]
    rows += [(0, [1.0, 2.0], 1), (200, None, 1), (201, [0.0, 0.0], 1), (202, [float("nan"), 1.0], 1), (203, [None, 1.0], 1), (204, [float("inf"), 1.0], 1), (None, [1.0, 2.0], 1), (205, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "vec_id as id", "vec_id as q", "label as rank")
    got = [(r.rank, r.vec_id, r.score) for r in nearest(df, F.col("id") == 0, k=5, books=2, words=4).orderBy("rank").collect()]
    assert got == [(1, 104, 6.0), (2, 1, 5.0), (3, 2, 5.0), (4, 3, 5.0), (5, 4, 5.0)]
    few = spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], SCHEMA)
    assert [(r.query_id, r.vec_id) for r in nearest(few, F.col("id") == 1, books=1, words=2).collect()] == [(1, 2)]
    assert nearest(df.limit(0), F.lit(True)).count() == 0


def test_codebooks():
    x = np.random.default_rng(1).normal(size=(500, 8))
    made = train(x, books=4, words=16)
    error = lambda b, beam: ((x - b.decode(b.encode(x, beam).astype(int))) ** 2).sum()
    assert error(made, 8) <= error(made, 1) < 0.5 * (x**2).sum()
    assert error(Codebooks(made.books[:2]), 8) > error(made, 8)


def test_nearest_of_rows_unlike_the_sample(spark):
    rng = np.random.default_rng(5)
    wide = rng.normal(size=(1200, 12)) * rng.lognormal(0, 2, size=(1200, 1))  # lengths of every size
    tight = rng.normal(size=12) * 3 + 1e-3 * rng.normal(size=(1200, 12))  # closer to one another than codes can tell
    tied = rng.integers(0, 2, size=(1200, 12)) * 40.0  # many equal products of different vectors
    x = np.concatenate([wide, tight, tied])
    ids = list(range(len(x)))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, label int")
    got = nearest(df, F.col("id") % 60 == 0, k=10, books=4, words=16, sample=600, shortlist=60, block=1000, queries_block=30).collect()
    hits = 0
    for q in range(0, len(x), 60):
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        score = np.add.accumulate(x * x[q], axis=1)[:, -1]
        hits += len(set(mine) & set([j for j in np.lexsort((ids, -score)) if j != q][:10]))
    assert hits >= 0.99 * 10 * len(range(0, len(x), 60))
