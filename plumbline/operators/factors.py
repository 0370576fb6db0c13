"""Which factor of a grid of runs matters: group summaries and eta squared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_stats(x: Column, prefix: str = "") -> list[Column]:
    """count, mean, median, population std, min, max and sum of the values that are not null."""
    names = ("count", "mean", "median", "std", "min", "max", "sum")
    made = (F.count(x), F.avg(x), F.percentile(x, F.lit(0.5)), F.stddev_pop(x), F.min(x), F.max(x), F.sum(x))
    return [c.alias(prefix + n) for n, c in zip(names, made, strict=True)]


def summary(df: DataFrame, factor: str, metric: str) -> DataFrame:
    """level, n, mean, median, sample std of the metric for each level of the factor."""
    m = F.col(metric)
    return df.groupBy(F.col(factor).cast("string").alias("level")).agg(F.count(m).alias("n"), F.avg(m).alias("mean"), F.percentile(m, F.lit(0.5)).alias("median"), F.stddev_samp(m).alias("std"))


def eta_squared(df: DataFrame, factors: list[str], metrics: list[str]) -> DataFrame:
    """(factor, metric, eta2, effect): the share of the metric's variance between the factor's levels, and how large that counts.

    All factors and metrics share one scan: rows are unfolded to (factor, level,
    metric, value) and summed up.
    """
    long = df.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])).alias("f"), *metrics
    ).select("f.*", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("m")).select("factor", "level", "m.*").where("x is not null")
    level = long.groupBy("factor", "metric", "level").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.sum("x").alias("s"), F.var_pop("x").alias("v"))
    grand = Window.partitionBy("factor", "metric")
    mean = F.sum("s").over(grand) / F.sum("n").over(grand)
    parts = level.withColumn("_between", F.col("n") * (F.col("mean") - mean) * (F.col("mean") - mean)).withColumn("_within", F.col("n") * F.col("v"))
    found = parts.groupBy("factor", "metric").agg(F.try_divide(F.sum("_between"), F.sum("_between") + F.sum("_within")).alias("eta2"))
    return found.withColumn("effect", effect_size(F.col("eta2")))


def effect_size(eta2: Column) -> Column:
    return F.when(eta2 < 0.01, "negligible").when(eta2 < 0.06, "small").when(eta2 < 0.14, "medium").when(eta2.isNotNull(), "large")


def alignment(a: Column, b: Column, bound: float = 0.06) -> Column:
    """Whether a factor matters for both of two metrics, for one, or for none."""
    return F.when((a >= bound) & (b >= bound), "both").when(a >= bound, "first only").when(b >= bound, "second only").otherwise("neither")


def best_level(df: DataFrame, factors: list[str], metric: str, largest: bool = True) -> DataFrame:
    """(factor, level, median): the level of each factor with the best median of the metric, ties by name."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])).alias("f"), F.col(metric).alias("x")).select("f.*", "x")
    med = long.groupBy("factor", "level").agg(F.percentile("x", F.lit(0.5)).alias("median"))
    order = F.desc("median") if largest else F.asc("median")
    return med.withColumn("_r", F.row_number().over(Window.partitionBy("factor").orderBy(order, "level"))).where("_r = 1").drop("_r")


def stat_string(x: Column, digits: int = 2) -> Column:
    """An aggregate: n, mean, median, population std and range as one text."""
    numbers = [F.round(v, digits) for v in (F.avg(x), F.percentile(x, F.lit(0.5)), F.stddev_pop(x), F.min(x), F.max(x))]
    f = f"%.{digits}f"
    return F.format_string(f"n=%d, mean={f}, median={f}, std={f}, range={f}-{f}", F.count(x), *numbers)


def columns_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(measure, mean, median) of each column over all rows, in one scan."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in columns])).alias("m")).select("m.*")
    return long.groupBy("measure").agg(F.avg("x").alias("mean"), F.percentile("x", F.lit(0.5)).alias("median"))


def row_mean(columns: list[Column]) -> Column:
    """The mean of a row's columns that aren't null."""
    known = F.filter(F.array(*[c.cast("double") for c in columns]), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def composite_summary(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return df.agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.count_if(c.isNull()).alias("nulls"))


def top_and_rest(counts: DataFrame, name: str, n: str, most: int, rest: str = "... more") -> DataFrame:
    """name, n, groups: the largest counts (ties by name), and all others as one row."""
    top = counts.orderBy(F.desc(n), name).limit(most).select(name)
    marked = counts.join(F.broadcast(top.withColumn("_top", F.lit(True))), name, "left")  # `most` rows
    return marked.groupBy(F.when(F.col("_top"), F.col(name)).otherwise(rest).alias(name)).agg(F.sum(n).alias(n), F.count("*").alias("groups"))


def wide(df: DataFrame, keys: list[str], level: str, levels: list[str], values: list[str]) -> DataFrame:
    """keys and the mean of each value at each of the given levels, as columns level_value: one scan, no look at the data for the levels."""
    cells = [F.avg(F.when(F.col(level) == k, F.col(v))).alias(f"{k}_{v}") for k in levels for v in values]
    return df.groupBy(*keys).agg(*cells)


def percentile_stats(x: Column) -> list[Column]:
    """n, mean, median, population std, p75, p90 and range of the values that aren't null; percentiles are exact, by straight lines between ranks."""
    at = lambda q: F.percentile(x, F.lit(q))
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), at(0.5).alias("median"), F.stddev_pop(x).alias("std"), at(0.75).alias("p75"), at(0.9).alias("p90"), (F.max(x) - F.min(x)).alias("range")]


def levels_by_median(df: DataFrame, factor: str, metric: str, most: int, largest: bool = True) -> DataFrame:
    """The `most` levels of a factor with the best medians of the metric (largest or smallest), ties by level, with n and their place."""
    found = df.groupBy(F.col(factor).alias("level")).agg(F.count(metric).alias("n"), F.percentile(metric, F.lit(0.5)).alias("median"))
    by = F.desc_nulls_last("median") if largest else F.asc_nulls_last("median")
    best = found.orderBy(by, "level").limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy(by, "level")))  # `most` rows


def spread_of_maps(df: DataFrame, values: str) -> DataFrame:
    """(metric, n, mean, std) over all rows' maps of metrics, whatever keys each has; a key that a row lacks, or has as null, doesn't count."""
    rows = df.select(F.explode(values).alias("metric", "x")).where("x is not null")
    return rows.groupBy("metric").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
