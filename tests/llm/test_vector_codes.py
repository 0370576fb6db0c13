import hashlib
import math
import random

import numpy as np
import pytest

from plumbline.llm import vector_codes

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    big = vector_codes.LARGEST
    whole = [[max(-big - 1, min(big, math.floor(256 * float(np.float32(x))))) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[tuple(w[p * width : p * width + width]) for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p]), []).append(c[p])
            books[p] = [tuple(sum(x) // len(groups[e]) for x in zip(*groups[e], strict=True)) if e in groups else old for e, old in enumerate(books[p])]
    out, totals = [], {}
    for (i, _, label), c in zip(kept, cut, strict=True):
        chosen = [nearest(c[p], books[p]) for p in range(parts)]
        error = sum(far(c[p], books[p][e]) for p, e in enumerate(chosen))
        out.append((i, "".join(f"{e:02x}" for e in chosen), error, label))
        totals[label] = totals.get(label, 0) + error
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(((i, code, error, totals[label], sha) for i, code, error, label in out), key=str)


def found(spark, rows, **kw):
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "label as id", "vec_id as error", "embedding as code").repartition(3)
    return sorted((tuple(r)[:5] for r in vector_codes.compress(spark, df, **kw).collect()), key=str)


def vectors(rng, n, width):
    return [[float(np.float32(rng.choice([0.0, -0.0, 1 / 256, rng.gauss(0, 1)]))) for _ in range(width)] for _ in range(n)]


@pytest.mark.parametrize("width", [32, 21])
def test_against_plain_loops(spark, width):
    rng = random.Random(width)
    some = vectors(rng, 150, width)
    rows = [(i * 3 % 151, v, rng.choice([None, 1, 2])) for i, v in enumerate(some)]
    rows += [rows[0], rows[0], (None, some[1], 1), (-5, None, 1), (-4, [], 1), (-3, [float("nan")] * width, 1), (-2, [float("inf")] * width, 2), (-1, [None] * width, 2), (7, some[2][:-1], 1), (8, [1e30] * width, 2), (9, [-1e30] * width, None)]
    assert found(spark, rows) == plain(rows)


def test_fewer_vectors_than_entries(spark):
    rows = [(i, v, 0) for i, v in enumerate(vectors(random.Random(3), 5, 16))]
    assert found(spark, rows) == plain(rows)
    rows = [(i, [1.5] * 16, None) for i in range(80)]
    got = found(spark, rows)
    assert got == plain(rows) and {r[1] for r in got} == {"00" * 16} and {r[2:4] for r in got} == {(0, 0)}


def test_empty_and_unusable_tables(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 1), (2, [float("nan")], 2)]) == []


def test_norm_expansion_is_exact_at_the_bound():
    rng = np.random.default_rng(1)
    big = vector_codes.LARGEST
    x, books = rng.integers(-big - 1, big + 1, (50, 2, 8)), rng.integers(-big - 1, big + 1, (2, 9, 8))
    x[:9, 0] = books[0]
    chosen, distance = vector_codes.assigned(x, books)
    far = ((x[:, :, None, :].astype(object) - books[None].astype(object)) ** 2).sum(axis=3)
    assert (chosen == far.astype(np.float64).argmin(axis=2)).all() and (distance == far.min(axis=2)).all() and (distance[:9, 0] == 0).all()
