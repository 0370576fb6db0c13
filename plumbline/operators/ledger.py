"""Soft filters: each row carries which named filters it passed and failed, and nothing is deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENTRY = "struct<name:string,meta_s:string,meta_d:double>"
TAG = "struct<tag:string,s:string,d:double>"


def with_ledger(df: DataFrame) -> DataFrame:
    """df with empty columns passed, failed and tags."""
    return df.withColumns({"passed": F.array().cast(f"array<{ENTRY}>"), "failed": F.array().cast(f"array<{ENTRY}>"), "tags": F.array().cast(f"array<{TAG}>")})


def _entry(name: str, s: Column | None, d: Column | None) -> Column:
    return F.struct(F.lit(name).alias("name"), (F.lit(None) if s is None else s).cast("string").alias("meta_s"), (F.lit(None) if d is None else d).cast("double").alias("meta_d"))


def annotate(df: DataFrame, name: str, passed: Column, meta_s: Column | None = None, meta_d: Column | None = None) -> DataFrame:
    """Record the filter in passed where the condition holds, in failed where it is false or null."""
    entry, ok = _entry(name, meta_s, meta_d), F.coalesce(passed, F.lit(False))
    return df.withColumns({"passed": F.when(ok, F.array_append("passed", entry)).otherwise(F.col("passed")), "failed": F.when(ok, F.col("failed")).otherwise(F.array_append("failed", entry))})


def tag(df: DataFrame, name: str | Column, s: Column | None = None, d: Column | None = None, when: Column | None = None) -> DataFrame:
    """Put a tag, with a text and a number beside it, on all rows or on those where the condition holds."""
    label = F.lit(name) if isinstance(name, str) else name
    value = F.struct(label.alias("tag"), (F.lit(None) if s is None else s).cast("string").alias("s"), (F.lit(None) if d is None else d).cast("double").alias("d"))
    more = F.array_append("tags", value)
    return df.withColumn("tags", more if when is None else F.when(when, more).otherwise(F.col("tags")))


def tag_counts(df: DataFrame, key: str) -> DataFrame:
    """(tag, n, n_rows, mean): how often each tag stands, on how many rows, and the mean of the numbers beside it."""
    return df.select(key, F.explode("tags").alias("_t")).groupBy(F.col("_t.tag").alias("tag")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_rows"), F.avg("_t.d").alias("mean"))


def passed_all(children: Column | None = None) -> Column:
    """Whether no filter failed on the row, nor on any of its children (structs with a `failed` array)."""
    own = F.size("failed") == 0
    return own if children is None else own & F.forall(children, lambda c: F.size(c["failed"]) == 0)


def did_fail(name: str) -> Column:
    return F.exists("failed", lambda f: f["name"] == name)


def did_pass(name: str) -> Column:
    return F.exists("passed", lambda f: f["name"] == name)


def sequence() -> Column:
    """The filters that the row passed, then those that it failed, as structs (name, passed)."""
    told = lambda c, ok: F.transform(c, lambda f: F.struct(f["name"].alias("name"), F.lit(ok).alias("passed")))
    return F.concat(told("passed", True), told("failed", False))


def summary() -> Column:
    """struct(n_passed, n_failed, passed, failed): numbers and names of the row's filters."""
    names = lambda c: F.transform(c, lambda f: f["name"])
    return F.struct(F.size("passed").alias("n_passed"), F.size("failed").alias("n_failed"), names("passed").alias("passed"), names("failed").alias("failed"))


def tag_values(name: str, number: bool = True) -> Column:
    """The numbers (or texts) beside the row's tags of that name, in their order."""
    return F.transform(F.filter("tags", lambda t: t["tag"] == name), lambda t: t["d" if number else "s"])


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that does not hold, null if all do."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


# The same ledger in long form: (row, seq, name, passed).


def reached_passed(events: DataFrame, row: str, name: str = "name", passed: str = "passed", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """For each filter, how many rows reached it and how many passed (a row's first time counts)."""
    first = Window.partitionBy(row, name).orderBy(*order)
    once = events.withColumn("_r", F.row_number().over(first)).where("_r = 1")
    return once.groupBy(name).agg(F.count("*").alias("reached"), F.count_if(passed).alias("n_passed"))


def flow(events: DataFrame, row: str, step: Column, order: tuple[str, ...] = ("seq",), depth: int = 4) -> DataFrame:
    """How many rows have each sequence of first steps (prefixes of 1 to depth steps, joined by ' > ')."""
    ranked = events.withColumn("_r", F.row_number().over(Window.partitionBy(row).orderBy(*order))).where(F.col("_r") <= depth)
    paths = ranked.groupBy(row).agg(F.array_sort(F.collect_list(F.struct("_r", step.alias("s")))).alias("_steps"))
    names = F.transform("_steps", lambda x: x["s"])
    prefixes = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("_steps")), lambda i: F.array_join(F.slice(names, 1, i), " > "))).alias("path"))
    return prefixes.groupBy("path").agg(F.count("*").alias("n"))


def children(paths: DataFrame, sep: str = " > ") -> DataFrame:
    """path, n, parent, place, share: each path's place among its parent's children (by falling n, then by name), and its part of the parent's n.

    A path of one step has no parent (null) and a part of all of them.
    """
    cut = F.split(F.col("path"), sep, -1)
    rows = paths.withColumn("parent", F.when(F.size(cut) > 1, F.array_join(F.slice(cut, 1, F.size(cut) - 1), sep)))
    own = Window.partitionBy("parent")
    above = paths.select(F.col("path").alias("parent"), F.col("n").alias("_above"))
    placed = rows.withColumn("place", F.row_number().over(own.orderBy(F.desc("n"), "path"))).withColumn("_all", F.sum("n").over(own))
    return placed.join(above, "parent", "left").select("path", "n", "parent", "place", (F.col("n") / F.coalesce("_above", "_all")).alias("share"))


def funnel(stages: DataFrame, removed: str = "removed", order: str = "seq") -> DataFrame:
    """Stages with what remains after each: the first stage's n less all removed so far. One row for each stage, so one task."""
    upto = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stages.withColumn("remaining", F.col("n") - F.sum(removed).over(upto))
