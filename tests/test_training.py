import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import probe, training

TOKENS = "problem long, line long, place long, embedding array<float>, y int"


def tokens(rng, problems=20, width=4):
    rows = []
    for p in range(problems):
        for place in range(rng.randrange(1, 9)):
            v = [rng.gauss(0, 1) for _ in range(width)]
            rows.append((p, place // 3, place, v, int(v[0] + 0.3 * rng.gauss(0, 1) > 0)))
    return rows


def batch_of(rows):
    return rows.select("problem", "fold", "lines", "places", "ys", "vectors").toArrow().combine_chunks().to_batches()[0]


@pytest.fixture(scope="module")
def problems(spark):
    return training.problem_rows(spark.createDataFrame(tokens(random.Random(1)), TOKENS), "problem", "line", "place", folds=3, batches=2).persist()


@pytest.mark.parametrize("pool", ["mean", "max"])
@pytest.mark.parametrize("loss", ["bce", "focal", "brier"])
def test_gradient_is_that_of_finite_differences(problems, pool, loss):
    model = training.LineProbe(4, hidden=3, pool=pool, loss=loss, folds=3)
    batch, gradient = batch_of(problems), model.gradient(model.sizes(problems))
    got = gradient(batch, model.start)
    for k in range(3):
        for i in range(model.size):
            step = np.zeros(model.start.shape)
            step[k, i] = 1e-6
            want = (gradient(batch, model.start + step)[k, -1] - gradient(batch, model.start - step)[k, -1]) / 2e-6
            assert abs(got[k, i] - want) < 1e-6 + 1e-5 * abs(want)


def plain_loss(rows, fold_of, model, parameters, k):
    """The three levels' mean losses, token by token."""
    sums, counts = {}, {}
    groups = {}
    for p, line, place, v, y in sorted(rows, key=lambda r: r[:3]):
        if fold_of[p] == k:
            continue
        a = model.forward(np.array([v], dtype=np.float32).astype(float), parameters[k])[0][0]
        for key in (("token", p, place), ("line", p, line), ("problem", p)):
            groups.setdefault(key, []).append((a, y))
    w, c = model._parts(parameters[k])[2:]
    for key, some in groups.items():
        pooled = np.mean([a for a, _ in some], axis=0)
        p = 1 / (1 + np.exp(-(pooled @ w + c)))
        y = min(y for _, y in some)
        sums[key[0]] = sums.get(key[0], 0) - np.log(p if y else 1 - p)
        counts[key[0]] = counts.get(key[0], 0) + 1
    return sum(wt * sums[level] / counts[level] for level, wt in zip(training.LEVELS, model.weights, strict=True))


def test_loss_is_the_plain_one_and_falls(problems):
    rows, model = tokens(random.Random(1)), training.LineProbe(4, hidden=3, folds=3)
    fold_of = {r.problem: r.fold for r in problems.collect()}
    parameters, losses = model.fit(problems, steps=30, rate=0.003)
    assert losses[0] == pytest.approx([plain_loss(rows, fold_of, model, model.start, k) for k in range(3)])
    assert (np.diff(losses, axis=0) < 0).all()
    after = training.summed(problems, model.gradient(model.sizes(problems)), parameters)[:, -1]
    assert after == pytest.approx([plain_loss(rows, fold_of, model, parameters, k) for k in range(3)])


def test_predictions_come_from_the_model_that_did_not_see_the_problem(spark, problems):
    model = training.LineProbe(4, hidden=3, folds=3)
    parameters = np.stack([model.start[0] * s for s in (1.0, 0.5, 2.0)])
    got = model.predict(problems, parameters).collect()
    rows = tokens(random.Random(1))
    assert sum(r.level == "token" for r in got) == len(rows) and sum(r.level == "problem" for r in got) == 20
    fold_of = {r.problem: r.fold for r in problems.collect()}
    by = {(r.problem, r.place): r for r in got if r.level == "token"}
    for p, _, place, v, y in rows:
        a = model.forward(np.array([v], dtype=np.float32).astype(float), parameters[fold_of[p]])[0][0]
        w, c = model._parts(parameters[fold_of[p]])[2:]
        assert by[p, place].p == pytest.approx(1 / (1 + np.exp(-(a @ w + c)))) and by[p, place].y == y and by[p, place].fold == fold_of[p]


def test_batches_in_turn_and_patience(problems):
    model = training.LineProbe(4, hidden=3, folds=3)
    parameters, losses = model.fit(problems, steps=40, rate=0.02, batches=2)
    whole = training.summed(problems, model.gradient(model.sizes(problems)), parameters)[:, -1]
    start = training.summed(problems, model.gradient(model.sizes(problems)), model.start)[:, -1]
    assert (whole < start).all() and len(losses) == 40
    best, losses = model.fit(problems, steps=60, rate=2.0, patience=3)
    assert len(losses) < 60
    kept = training.summed(problems, model.gradient(model.sizes(problems)), best)[:, -1]
    assert kept == pytest.approx(losses.min(axis=0))


def test_each_model_of_the_grid_equals_its_single_fit(spark):
    rng = random.Random(4)
    rows = [(i % 4, v := [rng.gauss(0, 1) for _ in range(3)], int(v[0] - v[1] > 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "fold int, embedding array<double>, y int").repartition(3)
    grid = [{"rate": r, "penalty": w, "loss": k} for r in (0.05, 0.2) for w in (0.0, 0.1) for k in ("bce", "focal", "brier")]
    table, found = training.linear_grid(spark, df, 4, grid, 3, steps=12)
    assert found.shape == (48, 4) and table.count() == 48
    for c in (0, 4, 11):
        one, alone = training.linear_grid(spark, df, 4, grid[c : c + 1], 3, steps=12)
        assert alone == pytest.approx(found[4 * c : 4 * c + 4])
        assert [r.brier for r in one.orderBy("fold").collect()] == pytest.approx([r.brier for r in table.where(F.col("configuration") == c).orderBy("fold").collect()])
    x, y, fold = (np.array([r[i] for r in rows], dtype=float) for i in (1, 2, 0))
    for k in range(4):
        p = 1 / (1 + np.exp(-(x[fold == k] @ found[k, :3] + found[k, 3])))
        row = table.where(f"configuration = 0 and fold = {k}").first()
        assert row.n == 50 and row.brier == pytest.approx(((p - y[fold == k]) ** 2).mean())
    best = {r.fold: r for r in training.best_by_fold(table).collect()}
    scores = {(r.configuration, r.fold): r.brier for r in table.collect()}
    for k in range(4):
        want = min(range(12), key=lambda c: (np.mean([scores[c, j] for j in range(4) if j != k]), c))
        assert best[k].configuration == want and best[k].brier == scores[want, k]


def test_spread_over_folds(spark):
    rows = [(0, 0.1, 0.0, "bce", 0, 5, 0.2, 0.5), (0, 0.1, 0.0, "bce", 1, 5, 0.4, 0.7), (0, 0.1, 0.0, "bce", 2, 0, None, None), (1, 0.2, 0.0, "bce", 0, 5, 0.3, 0.1)]
    grid = spark.createDataFrame(rows, "configuration int, rate double, penalty double, loss string, fold int, n long, brier double, log_loss double")
    got = {r.configuration: r for r in training.spread_by_configuration(grid).collect()}
    assert (got[0].folds, got[1].folds) == (2, 1) and got[0].brier_mean == pytest.approx(0.3) and got[0].brier_std == pytest.approx(0.1) and got[1].log_loss_std == 0


def test_losses_and_slopes():
    z = np.array([-30.0, -2.0, 0.0, 1.5, 30.0])
    for kind in ("bce", "focal", "brier"):
        for label in (0.0, 1.0):
            y = np.full(z.shape, label)
            loss, slope = training.losses_of(z, y, kind)
            near = (training.losses_of(z + 1e-6, y, kind)[0] - training.losses_of(z - 1e-6, y, kind)[0]) / 2e-6
            assert slope == pytest.approx(near, abs=1e-6) and (loss >= 0).all()


def test_empty_rows(spark):
    none = training.problem_rows(spark.createDataFrame([], TOKENS), "problem", "line", "place", folds=3)
    model = training.LineProbe(4, hidden=2, folds=3)
    parameters, losses = model.fit(none, steps=2)
    assert (losses == 0).all() and model.predict(none, parameters).collect() == []


def test_multi_head_pool(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else "b", [rng.gauss(0, 30) for _ in range(5)]) for i in range(90)]
    heads = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(3)]
    df = spark.createDataFrame(rows, "id int, g string, embedding array<double>")
    for salts in (1, 7):
        got = {(r.g, r.head, r.i): r.pooled for r in probe.multi_head_pool(df, "g", "id", heads, salts=salts).collect()}
        for g in ("hot", "b"):
            x = np.array([v for _, k, v in rows if k == g])
            for h, q in enumerate(heads):
                w = np.exp(x @ np.array(q) - (x @ np.array(q)).max())
                assert [got[g, h, i] for i in range(5)] == pytest.approx((w[:, None] * x).sum(axis=0) / w.sum())
