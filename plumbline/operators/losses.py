"""Losses of predictions over several levels, and when training should stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms(p: Column, y: Column, clip: float = 1e-6) -> dict[str, Column]:
    """Mean losses by name: cross entropy, focal loss with gamma 2, and twice the Brier score."""
    c = F.greatest(F.lit(clip), F.least(p, F.lit(1 - clip)))
    right = F.when(y == 1, c).otherwise(1 - c)
    return {"bce": F.avg(-F.log(right)), "fl2": F.avg(-(1 - right) * (1 - right) * F.log(right)), "brier": 2 * F.avg((c - y) * (c - y))}


def combined(tokens: DataFrame, weights: dict[str, float], keys: list[str], problem: str = "problem_id", line: str = "line_id", p: str = "p", y: str = "y") -> DataFrame:
    """keys, bce, fl2, brier: the weighted sum of the losses of tokens, lines and problems, whose p is the mean and y the least of their tokens.

    Lines are summed up from tokens and problems from lines, so tokens are read twice and shuffled once.
    """
    sums = [F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.min(y).alias(y)]
    lines = tokens.groupBy(*keys, problem, line).agg(F.sum(p).alias("_s"), F.count("*").alias("_n"), F.min(y).alias(y))
    problems = lines.groupBy(*keys, problem).agg(*sums)
    mean = F.col("_s") / F.col("_n")
    levels = {"token": tokens.select(*keys, p, y), "line": lines.select(*keys, mean.alias(p), y), "problem": problems.select(*keys, mean.alias(p), y)}
    out: DataFrame | None = None
    for name, df in levels.items():
        part = df.groupBy(*keys).agg(*[(F.lit(weights.get(name, 0.0)) * c).alias(k) for k, c in terms(F.col(p), F.col(y)).items()])
        out = part if out is None else out.union(part)
    return out.groupBy(*keys).agg(*[F.sum(k).alias(k) for k in ("bce", "fl2", "brier")])


def early_stop(steps: DataFrame, key: str, step: str, loss: str, patience: int) -> DataFrame:
    """key, stopped (the first step that is `patience` steps after the last new best loss; null if there is none), best, steps."""
    order = Window.partitionBy(key).orderBy(step)
    d = steps.withColumn("_best", F.min(loss).over(order))
    before = F.lag("_best").over(order)
    d = d.withColumn("_at", F.when(before.isNull() | (F.col("_best") < before), F.col(step)))
    d = d.withColumn("_waited", F.col(step) - F.max("_at").over(order))
    return d.groupBy(key).agg(F.min(F.when(F.col("_waited") >= patience, F.col(step))).alias("stopped"), F.min("_best").alias("best"), F.count("*").alias("steps"))
