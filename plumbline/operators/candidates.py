"""Candidate repairs of problems by several adders: the best one, who overlaps, who matters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.tables import tagged_union


def score(passed: Column, passed_filters: Column, similarity: Column) -> Column:
    """A failing candidate costs 100000 less 1000 for each filter that it passed; a difference costs 100 times itself."""
    return F.when(passed, F.lit(0.0)).otherwise(F.lit(-100000.0) + 1000.0 * passed_filters) - 100.0 * (1 - similarity)


def pick_best(df: DataFrame, problem: str, by: Column, tie: list[str]) -> DataFrame:
    """The row of each problem with the largest `by`; of several the first by tie."""
    first = Window.partitionBy(problem).orderBy(by.desc(), *tie)
    return df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def pairs(df: DataFrame, problem: str, adder: str) -> DataFrame:
    """(a, b, n): problems that both adders a < b have a candidate for."""
    who = df.groupBy(problem).agg(F.array_sort(F.collect_set(adder)).alias("_who"))
    a = who.select(F.posexplode("_who").alias("_i", "a"), "_who")
    return a.select("a", F.explode(F.slice("_who", F.col("_i") + 2, F.size("_who"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def exclusive(df: DataFrame, problem: str, adder: str) -> DataFrame:
    """(adder, n): problems that only this adder has a candidate for."""
    only = df.groupBy(problem).agg(F.count_distinct(adder).alias("_n"), F.min(adder).alias(adder)).where("_n = 1")
    return only.groupBy(adder).agg(F.count("*").alias("n"))


def leave_one_out(df: DataFrame, problem: str, adder: str, distance: str) -> DataFrame:
    """For each adder: problems where it has the least distance alone, how much larger the least distance gets without it in all, and problems that nobody else solves.

    Only each problem's two least adder distances are needed.
    """
    best = df.groupBy(problem, adder).agg(F.min(distance).alias("_d"))
    ranked = best.withColumn("_r", F.row_number().over(Window.partitionBy(problem).orderBy("_d", adder))).where("_r <= 2")
    two = ranked.groupBy(problem).agg(
        F.min_by(adder, "_r").alias(adder), F.min("_d").alias("_first"), F.max("_d").alias("_second"), F.count("*").alias("_n")
    )
    worse = F.when(F.col("_n") == 2, F.col("_second") - F.col("_first"))
    return two.groupBy(adder).agg(F.count_if(F.col("_n") == 2).alias("best_in"), F.coalesce(F.sum(worse), F.lit(0.0)).alias("added_distance"), F.count_if(F.col("_n") == 1).alias("only_solver"))


#: Places of a problem that are unfolded against each other at a time.
PART = 256


def keep_chances(df: DataFrame, keys: list[str], problem: str, place: str, kept: str, part: int = PART) -> DataFrame:
    """keys, i, j, p_i, p_j, p_ij, p_i_given_j of all pairs of places that a problem has both of: chances over the problems; p_i_given_j is 0 where p_j is.

    A problem's places are dealt into parts of about PART, and each two parts
    are unfolded against each other in a row, so that a long problem's pairs are
    spread over tasks; sums by pair are pre-aggregated.
    """
    sizes = df.groupBy(*keys, problem).agg(F.ceil(F.count("*") / part).cast("int").alias("_n"))
    dealt = df.join(sizes, [*keys, problem]).withColumn("_c", F.pmod(F.xxhash64(F.col(place).cast("string")), F.col("_n")).cast("int"))
    sets = dealt.groupBy(*keys, problem, "_n", "_c").agg(F.collect_list(F.struct(F.col(place).alias("at"), F.col(kept).cast("double").alias("k"))).alias("_p"))
    others = sets.select(*keys, problem, F.col("_c").alias("_d"), F.col("_p").alias("_q"))
    both = sets.withColumn("_d", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).join(others, [*keys, problem, "_d"])
    pairs = both.select(*keys, F.explode("_p").alias("_a"), "_q").select(*keys, "_a", F.explode("_q").alias("_b"))
    n = df.groupBy(*keys).agg(F.count_distinct(problem).alias("_n"))  # a row for each group of keys
    joint = pairs.groupBy(*keys, F.col("_a.at").alias("i"), F.col("_b.at").alias("j")).agg(F.sum(F.col("_a.k") * F.col("_b.k")).alias("_ij"))
    joint = joint.join(n, keys).withColumn("p_ij", F.col("_ij") / F.col("_n"))
    own = joint.where("i = j").select(*keys, F.col("i").alias("_place"), F.col("p_ij").alias("_m"))
    out = joint.join(own.withColumnsRenamed({"_place": "i", "_m": "p_i"}), [*keys, "i"]).join(own.withColumnsRenamed({"_place": "j", "_m": "p_j"}), [*keys, "j"])
    return out.select(*keys, "i", "j", "p_i", "p_j", "p_ij", F.when(F.col("p_j") == 0, 0.0).otherwise(F.col("p_ij") / F.col("p_j")).alias("p_i_given_j"))


def gathered(df: DataFrame, providers: dict[str, Callable[[DataFrame], DataFrame]], name: str = "adder") -> DataFrame:
    """The candidates of all providers, each a function from the problems' table to candidates, with the provider's name."""
    return tagged_union({k: f(df) for k, f in providers.items()}, name)


def more_minimal(first: DataFrame, again: DataFrame, problem: str, adder: str, distance: str) -> DataFrame:
    """The nearest candidate of each problem that has a first one, out of it and a second round's, ties by adder."""
    second = again.join(first.select(problem), problem, "left_semi").select(*first.columns)
    return pick_best(first.union(second), problem, -F.round(distance, 9), [adder])
