import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import expr
from plumbline.operators import calibration, rescale


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, p double, y long")


def test_values_on_edges_follow_the_linspace_doubles(spark):
    rows = [("a", p, 1) for p in (0.0, 0.1, 0.3, 0.6, 0.7, 1.0)]
    got = {r.p: r.b for r in frame(spark, rows).select("p", expr.bin_of(F.col("p"), expr.linspace(10)).alias("b")).collect()}
    edges = np.linspace(0, 1, 11)
    assert got == {p: min(9, int(np.searchsorted(edges[1:-1], p, side="right"))) for p in got}
    assert got[0.3] == 2


def test_metrics_match_numpy(spark):
    rng = random.Random(3)
    rows = [("a", round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(500)]
    r = calibration.metrics(frame(spark, rows), ["g"]).first()
    p, y = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    assert r.brier == pytest.approx(((p - y) ** 2).mean())
    pos, neg = p[y == 1], p[y == 0]
    assert r.auc == pytest.approx(((pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2))
    b = np.minimum(np.searchsorted(np.linspace(0, 1, 11)[1:-1], p, side="right"), 9)
    assert r.ece == pytest.approx(sum(abs(p[b == k].mean() - y[b == k].mean()) * (b == k).mean() for k in set(b)))


def test_one_class_has_no_auc_and_no_skill(spark):
    r = calibration.metrics(frame(spark, [("a", 0.2, 1), ("a", 0.9, 1)]), ["g"]).first()
    assert r.auc is None and r.bss is None and r.ref_brier == 0


def test_empty_table(spark):
    assert calibration.metrics(frame(spark, []), ["g"]).count() == 0


def test_gmean_with_a_zero_is_zero(spark):
    assert frame(spark, [("a", 0.0, 1), ("a", 0.5, 1)]).agg(expr.gmean(F.col("p")).alias("x")).first().x == 0


def test_platt_recovers_a_known_scale(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=20_000)
    y = rng.random(20_000) < 1 / (1 + np.exp(-(0.5 * x - 1)))
    p = np.round(1 / (1 + np.exp(-x)), 3)
    r = rescale.platt(frame(spark, [("a", float(a), int(b)) for a, b in zip(p, y)]), ["g"]).first()
    assert r.a == pytest.approx(0.5, abs=0.05) and r.b == pytest.approx(-1, abs=0.05) and r.n == 20_000


def test_platt_of_one_class_stays_finite(spark):
    r = rescale.platt(frame(spark, [("a", 0.5, 1), ("a", 0.5, 1)]), ["g"]).first()
    assert math.isfinite(r.a) and math.isfinite(r.b)


def test_histogram_gives_every_row_a_value(spark):
    rows = [("a", i / 100, i % 2) for i in range(101)]
    df = frame(spark, rows)
    scaled = rescale.apply_histogram(df, rescale.histogram(df, ["g"], ["y"]), ["g"])
    assert scaled.count() == 101 and scaled.where("scaled is null").count() == 0


def test_platt_where_newton_runs_away():
    """Probabilities far from what happens: plain steps leave the finite numbers, the halved ones reach the least loss."""
    import numpy as np

    from plumbline.operators import rescale

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(-9, 0.5, 40), rng.normal(9, 0.5, 40)])
    n, pos = np.ones(80), (rng.random(80) < 0.5).astype(float)
    a, b = rescale.fitted(x, n, pos)
    loss = lambda a, b: (np.logaddexp(0, a * x + b) - pos * (a * x + b)).sum()
    assert np.isfinite([a, b]).all() and loss(a, b) < loss(1, 0)
    near = [loss(a + da, b + db) for da in (-1e-3, 0, 1e-3) for db in (-1e-2, 0, 1e-2)]
    assert loss(a, b) == min(near)
    well = rng.normal(0, 1, 500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.7 * well - 0.2)))).astype(float)
    a, b = rescale.fitted(well, np.ones(500), y)
    q = 1 / (1 + np.exp(-(a * well + b)))
    assert abs((q - y).sum()) < 1e-9 and abs(((q - y) * well).sum()) < 1e-9
