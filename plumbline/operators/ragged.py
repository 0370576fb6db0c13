"""Rows of different lengths as batches with a budget: flat arrays with spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_starts(df: DataFrame, order: str, size: str, width: int) -> DataFrame:
    """df with start: the sum of size over all rows that come before by `order` (a whole number, each once).

    Rows are summed in buckets of `width` numbers, and the buckets' totals (a
    row each) are summed by one window; so no task has more rows than a bucket,
    and the totals are as many as the numbers' range by width.
    """
    rows = df.withColumn("_bucket", F.floor(F.col(order) / width))
    within = Window.partitionBy("_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum(size).over(within), F.lit(0)))
    totals = rows.groupBy("_bucket").agg(F.sum(size).alias("_total"))
    before = totals.select("_bucket", F.coalesce(F.sum("_total").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, "_bucket").withColumn("start", (F.col("_before") + F.col("_inside")).cast("long")).drop("_bucket", "_inside", "_before")


def batches(df: DataFrame, order: str, values: str, budget: int, width: int = 10_000) -> DataFrame:
    """(batch, flat, spans): the arrays `values` of consecutive rows joined, and the struct (key, at, n) of each row in them.

    A batch takes the rows that start within budget - longest + 1 elements, so
    that none holds more than the budget; a row longer than the budget fails
    the job. Null and empty arrays have a span of no elements. Rows have
    distinct whole numbers as `order`.
    """
    sized = df.select(F.col(order).alias("_key"), F.coalesce(F.col(values), F.array().cast(df.schema[values].dataType)).alias("_values")).withColumn("_n", F.size("_values"))
    longest = sized.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("_longest"))
    placed = running_starts(sized, "_key", "_n", width).crossJoin(F.broadcast(longest))  # one row
    step = F.when(F.col("_longest") > budget, F.raise_error(F.lit("a row is longer than the budget")).cast("long")).otherwise(budget + 1 - F.col("_longest"))
    parts = placed.select(F.floor(F.col("start") / step).alias("batch"), "start", "_key", "_n", "_values")
    rows = parts.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("_key", "start", "_n", "_values"))).alias("_rows"))
    first = F.get("_rows", F.lit(0))["start"]
    spans = F.transform("_rows", lambda r: F.struct(r["_key"].alias("key"), (r["start"] - first).cast("int").alias("at"), r["_n"].alias("n")))
    return rows.select("batch", F.flatten(F.transform("_rows", lambda r: r["_values"])).alias("flat"), spans.alias("spans"))


def unpacked(found: DataFrame) -> DataFrame:
    """(key, values): the rows that batches were made of."""
    rows = F.transform("spans", lambda s: F.struct(s["key"].alias("key"), F.slice("flat", s["at"] + 1, s["n"]).alias("values")))
    return found.select(F.explode(rows).alias("r")).select("r.*")
