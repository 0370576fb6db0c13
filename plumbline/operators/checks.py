"""Checks of rows: domains, rejects with reasons, and small predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def domain_report(df: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """keys, n, and how many rows have a p that is no number, a p outside [0, 1], or a label other than 0 and 1."""
    x = F.col(p)
    nan = x.isNull() | F.isnan(x)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(nan).alias("not_a_number"), F.count_if(~nan & ((x < 0) | (x > 1))).alias("outside"), F.count_if(~F.col(y).isin(0, 1)).alias("bad_label"))


def checked(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """df; a row with a p outside [0, 1], without a p, or with a label other than 0 and 1 fails the job when it is read."""
    x = F.col(p)
    good = x.isNotNull() & ~F.isnan(x) & (x >= -1e-6) & (x <= 1 + 1e-6) & F.col(y).isin(0, 1)
    return df.withColumn(p, F.when(F.coalesce(good, F.lit(False)), x).otherwise(F.raise_error(F.concat(F.lit("not in its domain: "), F.coalesce(x.cast("string"), F.lit("null")))).cast("double")))


def reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that holds; null if none does."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in checks])


def accepted_and_rejected(df: DataFrame, checks: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """The rows that no check names, and those that one does, with `reason`; both read the same source."""
    marked = df.withColumn("reason", reason(checks))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def examples(df: DataFrame, not_keeps: Column, total: Column, length: Column) -> DataFrame:
    """Rows that are short enough to show: 1 to 30 marks, at most 50 tokens, less than 500 signs."""
    return df.where(not_keeps.between(1, 30) & (total <= 50) & (length < 500))


def starts_marked(text: Column, mark: str, within: int = 50) -> Column:
    """Whether the mark stands in the first signs of a text."""
    return F.contains(F.substring(text, 1, within), F.lit(mark))
