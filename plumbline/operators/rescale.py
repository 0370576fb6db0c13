"""Rescaling of probabilities: Platt, temperature and histogram calibrators as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from plumbline.functions.expr import logit, sigmoid
from plumbline.operators.calibration import bin_edges, equal_count_bins, scores

#: Newton steps; from (1, 0) eight are enough for double precision on overlapping classes.
STEPS = 8
#: Steps where plain ones run away.
DAMPED = 50
#: Sums by probability of a group that one task takes at once.
MOST_SUMS = 100_000


def platt(df: DataFrame, keys: list[str], intercept: bool = True, steps: int = STEPS, p: str = "p", y: str = "y") -> DataFrame:
    """keys, a, b, n: the logistic regression of y on logit(p), without penalty, by Newton's method from a = 1, b = 0.

    Rows are first summed up by distinct probability, so a step costs little
    however many rows there are. A group whose Hessian is singular (one class, or
    one probability) keeps the last values that it had.
    """
    small = scores(df, keys, p, y)
    total = small.groupBy(*keys).agg(F.sum("n").alias("n"))
    fitted = _newton(small, keys, intercept, steps)
    return fitted.join(total, keys) if keys else fitted.crossJoin(total)


def apply_platt(df: DataFrame, fitted: DataFrame, keys: list[str], p: str = "p", out: str = "scaled") -> DataFrame:
    fitted = fitted.select(*keys, F.col("a").alias("_a"), F.col("b").alias("_b"))
    joined = df.join(fitted, keys) if keys else df.crossJoin(fitted)
    return joined.withColumn(out, sigmoid(F.col("_a") * logit(F.col(p)) + F.col("_b"))).drop("_a", "_b")


def out_of_fold(df: DataFrame, keys: list[str], fold: str, k: int, intercept: bool = True, p: str = "p", y: str = "y", out: str = "scaled", n: str | None = None) -> DataFrame:
    """Rows with the probability that a calibrator gives which was fit on the other folds of their group.

    The sums by probability are taken once; each fold's training sums are the
    group's without the fold's own. n: how many rows a row stands for (see scores).
    """
    held = scores(df, [*keys, fold], p, y, n).withColumn("_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where(F.col("_fold") != F.col(fold))
    train = held.groupBy(*keys, "_fold", "p").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    fitted = _newton(train.withColumnRenamed("_fold", fold), [*keys, fold], intercept, STEPS)
    return apply_platt(df.withColumn(fold, F.col(fold).cast("int")), fitted, [*keys, fold], p, out)


def leave_one_out(df: DataFrame, keys: list[str], held: str, intercept: bool = True, p: str = "p", y: str = "y", out: str = "scaled") -> DataFrame:
    """Rows with the probability that a calibrator gives which was fit on all rows of their keys but those with their own value of `held`.

    Sums by probability are taken once; a value's training sums are the totals
    without its own, so that all calibrators are fitted from one scan.
    """
    own = scores(df, [*keys, held], p, y)
    total = own.groupBy(*keys, "p").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    values = own.select(*keys, held).distinct()
    wanted = total.join(values, keys) if keys else total.crossJoin(F.broadcast(values))  # a row for each value
    without = wanted.join(own, [*keys, held, "p"], "left")
    left = without.select(*keys, held, "p", (F.col("_n") - F.coalesce("n", F.lit(0))).alias("n"), (F.col("_pos") - F.coalesce("pos", F.lit(0))).alias("pos")).where("n > 0")
    return apply_platt(df, _newton(left, [*keys, held], intercept, STEPS), [*keys, held], p, out)


def _newton(small: DataFrame, keys: list[str], intercept: bool, steps: int) -> DataFrame:
    """keys, a, b from sums by probability.

    The sums are kept (a lost part is worked out again from its lineage). If no
    group has more than MOST_SUMS of them, each is fitted where it lies; larger
    groups take a join and an aggregate for each step.
    """
    small = small.withColumn("x", logit(F.col("p"))).select(*keys, "x", "n", "pos").persist()
    largest = small.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest > MOST_SUMS:
        now = small.groupBy(*keys).agg(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
        for _ in range(steps):
            now = _step(small.join(now, keys) if keys else small.crossJoin(F.broadcast(now)), keys, intercept)
        return now
    fields = [f.name for f in small.schema if f.name in keys]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        a, b = fitted(*(group[c].to_numpy(dtype=float) for c in ("x", "n", "pos")), intercept, steps)
        return pd.DataFrame([[*group[fields].iloc[0], a, b]], columns=[*fields, "a", "b"])

    schema = StructType([*(small.schema[k] for k in fields), StructField("a", DoubleType()), StructField("b", DoubleType())])
    return small.groupBy(*keys).applyInPandas(fit, schema).select(*keys, "a", "b")


def fitted(x: np.ndarray, n: np.ndarray, pos: np.ndarray, intercept: bool = True, steps: int = STEPS) -> tuple[float, float]:
    """Slope and intercept after Newton's steps from (1, 0); a step with a singular Hessian isn't taken.

    Where that ends worse than it began (Newton's method may run away), the
    steps are taken again, each halved until the loss falls, up to DAMPED times.
    """

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((n * np.logaddexp(0, z) - pos * z).sum())

    def step(a: float, b: float) -> tuple[float, float]:
        q = 0.5 * (1 + np.tanh(0.5 * (a * x + b)))
        w, e = n * q * (1 - q), pos - n * q
        ga, gb, haa, hab, hbb = (e * x).sum(), e.sum(), (w * x * x).sum(), (w * x).sum(), w.sum()
        det = haa * hbb - hab * hab
        if not intercept:
            return (ga / haa if haa else 0.0), 0.0
        return ((hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det) if det else (0.0, 0.0)

    a, b, begun = 1.0, 0.0, loss(1.0, 0.0)
    with np.errstate(all="ignore"):
        for _ in range(steps):
            da, db = step(a, b)
            a, b = a + da, b + db
        if np.isfinite([a, b]).all() and loss(a, b) <= begun * (1 + 1e-12):
            return float(a), float(b)
        a, b, now = 1.0, 0.0, begun
        for _ in range(DAMPED):
            da, db = step(a, b)
            part = 1.0
            while part > 1e-9 and not (np.isfinite([da, db]).all() and loss(a + part * da, b + part * db) < now):
                part /= 2
            if part <= 1e-9:
                break
            a, b = a + part * da, b + part * db
            now = loss(a, b)
    return float(a), float(b)


def _step(joined: DataFrame, keys: list[str], intercept: bool) -> DataFrame:
    q = sigmoid(F.col("a") * F.col("x") + F.col("b"))
    w, e = F.col("n") * q * (1 - q), F.col("pos") - F.col("n") * q
    sums = joined.groupBy(*keys, "a", "b").agg(
        F.sum(e * F.col("x")).alias("ga"), F.sum(e).alias("gb"), F.sum(w * F.col("x") * F.col("x")).alias("haa"), F.sum(w * F.col("x")).alias("hab"), F.sum(w).alias("hbb")
    )
    det = F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab")
    da = F.try_divide(F.col("hbb") * F.col("ga") - F.col("hab") * F.col("gb"), det) if intercept else F.try_divide("ga", "haa")
    db = F.try_divide(F.col("haa") * F.col("gb") - F.col("hab") * F.col("ga"), det) if intercept else F.lit(0.0)
    return sums.select(*keys, F.coalesce(F.col("a") + da, "a").alias("a"), F.coalesce(F.col("b") + db, "b").alias("b"))


def histogram(df: DataFrame, keys: list[str], order: list[str], n_bins: int = 10, score: str = "acc", p: str = "p", y: str = "y") -> DataFrame:
    """keys, bin, lo, edge, value: equal-count bins with their mean label (score acc) or mean probability (conf)."""
    found = bin_edges(equal_count_bins(df, keys, order, n_bins, p, y), keys)
    low = F.lag("edge").over(Window.partitionBy(*keys).orderBy("bin"))
    return found.select(*keys, "bin", F.coalesce(low, F.lit(float("-inf"))).alias("lo"), "edge", F.col(score).alias("value"))


def apply_histogram(df: DataFrame, fitted: DataFrame, keys: list[str], p: str = "p", out: str = "scaled") -> DataFrame:
    """Rows with the value of the first bin whose edge is not below p (a probability over the last edge gets the last)."""
    last = Window.partitionBy(*keys)
    marked = fitted.withColumn("_top", F.max("bin").over(last)).withColumnsRenamed({"lo": "_lo", "edge": "_edge", "value": "_value", "bin": "_bin"})
    inside = (F.col(p) > F.col("_lo")) & ((F.col(p) <= F.col("_edge")) | (F.col("_bin") == F.col("_top")))
    joined = df.join(marked, keys).where(inside) if keys else df.crossJoin(F.broadcast(marked)).where(inside)
    return joined.withColumn(out, F.col("_value")).drop("_lo", "_edge", "_value", "_bin", "_top")


def with_base_rate(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """One row: a and b of the calibrator of all rows, n, and the share of ones."""
    return platt(df, [], p=p, y=y).crossJoin(df.agg(F.avg(F.col(y).cast("double")).alias("base_rate")))


def arrays(df: DataFrame, columns: dict[str, tuple[float, float]]) -> DataFrame:
    """df with each probability of the array columns p as sigmoid(a * logit(p) + b)."""
    scale = lambda a, b: lambda p: sigmoid(a * logit(p) + b)
    return df.withColumns({c: F.transform(c, scale(a, b)) for c, (a, b) in columns.items()})


def by_property(df: DataFrame, scales: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """df with each named column put through its own scale; other columns stay."""
    return df.withColumns({c: f(F.col(c)) for c, f in scales.items() if c in df.columns})
