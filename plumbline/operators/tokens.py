"""Positional features of token rows (problem, pos, text) by windows over one partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = ("(", "[", "{"), (")", "]", "}")


PATTERN = r"\n|[A-Za-z_]+|[0-9]+|[^\sA-Za-z0-9_]"


def explode_tokens(df: DataFrame, pattern: str = PATTERN, key: str = "problem_id", text: str = "text", dealt: bool = False, parts: int | None = None) -> DataFrame:
    """(key, pos, token) of the matches of a pattern, from 0.

    dealt: the texts are dealt out by key before they are taken apart, so that
    windows and sums by key need no exchange of the tokens themselves; into `parts` of them, if given
    (a text has many more tokens than bytes tell Spark when it joins parts up).
    """
    df = df.select(key, text)
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), 0)
    if dealt:
        df = df.repartition(key) if parts is None else df.repartition(parts, key)
    return df.select(key, F.posexplode(found).alias("pos", "token"))


def line_ids(df: DataFrame, key: str = "problem_id", pos: str = "pos", token: str = "token") -> DataFrame:
    """line_id from 0: a line begins after a token that ends with a line break, and at one that holds a break inside."""
    order = Window.partitionBy(key).orderBy(pos)
    ends, has = F.col(token).endswith("\n"), F.contains(F.col(token), F.lit("\n"))
    flag = F.coalesce(F.lag(ends.cast("int")).over(order), F.lit(0)) + (has & ~ends & (F.col(pos) > 0)).cast("int")
    df = df.withColumn("_flag", F.when(flag > 0, 1).otherwise(0))
    return df.withColumn("line_id", F.sum("_flag").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("long")).drop("_flag")


def nesting(df: DataFrame, key: str = "problem_id", pos: str = "pos", token: str = "token") -> DataFrame:
    """Open brackets before each token; a closing bracket too many counts for nothing."""
    order = Window.partitionBy(key).orderBy(pos)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col(token).isin(*OPEN), 1).when(F.col(token).isin(*CLOSE), -1).otherwise(0)
    df = df.withColumn("_s", F.sum(step).over(upto)).withColumn("_low", F.least(F.lit(0), F.min("_s").over(upto)))
    return df.withColumn("level", F.coalesce(F.lag(F.col("_s") - F.col("_low")).over(order), F.lit(0)).cast("long")).drop("_s", "_low")


def neighbours(df: DataFrame, key: str = "problem_id", pos: str = "pos", token: str = "token") -> DataFrame:
    order = Window.partitionBy(key).orderBy(pos)
    before, after = F.lag(token).over(order), F.lead(token).over(order)
    return df.select(
        "*",
        ((F.coalesce(F.length(before), F.lit(0)) + F.coalesce(F.length(after), F.lit(0))) / 2).alias("near_length"),
        F.coalesce(after.isin(*OPEN, *CLOSE), F.lit(False)).alias("before_bracket"),
        F.coalesce(before == ".", F.lit(False)).alias("after_dot"),
        F.coalesce(after == "=", F.lit(False)).alias("before_equals"),
    )


def seen_within(df: DataFrame, word: str, back: int = 10, key: str = "problem_id", pos: str = "pos", token: str = "token") -> DataFrame:
    """Whether the word stands among the `back` tokens before."""
    frame = Window.partitionBy(key).orderBy(pos).rowsBetween(-back, -1)
    return df.withColumn("seen", F.coalesce(F.max((F.col(token) == word).cast("int")).over(frame), F.lit(0)) == 1)


def after_in_line(df: DataFrame, word: str, key: str = "problem_id", pos: str = "pos", token: str = "token", line: str = "line_id") -> DataFrame:
    """Whether the word stands earlier in the same line."""
    frame = Window.partitionBy(key, line).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("after_word", F.coalesce(F.max((F.col(token) == word).cast("int")).over(frame), F.lit(0)) == 1)


def places(df: DataFrame, key: str = "problem_id", pos: str = "pos", token: str = "token") -> DataFrame:
    """start (signs before the token), relative place in [0, 1], and tokens to the end."""
    order = Window.partitionBy(key).orderBy(pos)
    n = F.count("*").over(Window.partitionBy(key))
    start = F.coalesce(F.sum(F.length(token)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return df.select("*", start.alias("start"), (F.col(pos) / F.greatest(n - 1, F.lit(1))).alias("relative"), (n - 1 - F.col(pos)).alias("to_end"))


def frequency_ranks(df: DataFrame, token: str = "token", prefix: int = 3) -> DataFrame:
    """(token, n, rank): 1 - rank / vocabulary, rank from 0 by falling count, ties by token.

    A token's place is the number of tokens with larger counts, those of its
    count with an earlier beginning, and its place among those that begin alike
    (by `prefix` signs). So the words that occur once, half of a vocabulary, are
    ranked in as many tasks as they have beginnings; only a row for each count
    and beginning, then for each count, goes through wider windows.
    """
    counts = df.groupBy(token).agg(F.count("*").alias("n")).withColumn("_head", F.substring(token, 1, prefix))
    heads = counts.groupBy("n", "_head").agg(F.count("*").alias("_m"))
    earlier = Window.partitionBy("n").orderBy(F.asc_nulls_first("_head")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_earlier", F.coalesce(F.sum("_m").over(earlier), F.lit(0)))
    sizes = heads.groupBy("n").agg(F.sum("_m").alias("_same"))
    larger = sizes.withColumn("_before", F.coalesce(F.sum("_same").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_same").over(Window.partitionBy()))
    placed = heads.join(larger, "n").select("n", "_head", (F.col("_before") + F.col("_earlier")).alias("_start"), "_all")
    own = counts.withColumn("_i", F.row_number().over(Window.partitionBy("n", "_head").orderBy(token)) - 1)
    ranked = own.join(placed.withColumnsRenamed({"n": "_n", "_head": "_of"}), (F.col("n") == F.col("_n")) & F.col("_head").eqNullSafe(F.col("_of")))
    return ranked.select(token, "n", (1 - (F.col("_start") + F.col("_i")) / F.col("_all")).alias("rank"))
