"""Folds, samples and caps that depend on keys only, so every run deals alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expr import hash_fold


def by_hash(df: DataFrame, key: str, k: int = 5, out: str = "fold") -> DataFrame:
    """A fold of 0..k-1 from SHA-256 of the key."""
    return df.withColumn(out, hash_fold(F.col(key), k))


def by_group(df: DataFrame, group: str, out: str = "fold", name: str = "fold_name") -> DataFrame:
    """Leave one group out: a fold for each group, numbered by name (the groups' names are ranked in one task)."""
    folds = df.select(group).distinct().withColumn(out, F.dense_rank().over(Window.orderBy(group)) - 1)
    return df.join(folds, group).withColumn(name, F.concat(F.lit("EvalDataset__"), F.col(group)))


def splits(df: DataFrame, k: int, fold: str = "fold", run: str = "run") -> DataFrame:
    """Each row once for each of k runs, as test where its fold is the run's and as train elsewhere."""
    runs = df.withColumn(run, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return runs.withColumn("split", F.when(F.col(run) == F.col(fold), "test").otherwise("train"))


def sample(df: DataFrame, share: Column, key: Column, within: list[str] | None = None) -> DataFrame:
    """floor(share * n) rows of each group of `within` (of all, if not given), in the order of the key: a distinct text of evenly spread signs, such as a hash in hex.

    Counts by the key's first three signs tell in which of these buckets a
    group's last row falls; only that bucket's rows are ranked.
    """
    keys = within or []
    marked = df.withColumn("_key", key).withColumn("_bucket", F.substring("_key", 1, 3))
    counts = marked.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    every, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # how many rows of each bucket are taken; 4096 buckets of a group for a key in hex
    room = counts.select(*keys, "_bucket", "_n", (F.floor(share * F.sum("_n").over(every)) - F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("_room")).where("_room > 0")
    joined = marked.join(room, [*keys, "_bucket"])
    whole = joined.where("_room >= _n")
    last = joined.where("_room < _n").withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy("_key"))).where("_rank <= _room").drop("_rank")
    return whole.union(last).select(*df.columns)


def capped(df: DataFrame, keys: list[str], most: int, order: list[Column]) -> DataFrame:
    """At most `most` rows of each group, the first by order."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= most).drop("_rank")


def spread(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, folds, mean, std (population): of each metric over the rows of df, a row for each fold; folds without the metric don't count."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("_m")).select(*keys, "_m.*").where("x is not null")
    return long.groupBy(*keys, "metric").agg(F.count("*").alias("folds"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
