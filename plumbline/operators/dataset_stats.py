"""Statistics of problems with their repairs by dataset, and of the adders that offered them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import code

#: Adders whose names hold this give the known right answer.
TRUTH = "ground_truth"


def problem_stats(problems: DataFrame, dataset: str = "dataset") -> DataFrame:
    """A row for each dataset and one for all (TOTAL): counts of solved, passing and patched problems, and means and medians over the passing ones.

    problems: dataset, base and fix (texts), ok (the first answer is right; null:
    not known), passed (all filters), patched (the repair is right), adder (the
    chosen one), tokens and changed (of the first answer). One scan and one
    shuffle of sums; medians are exact, from counts of distinct values.
    """
    rows = problems.withColumns({"_base": code.comment_stats(F.col("base")), "_fix": code.comment_stats(F.col("fix"))})
    ok, passed = F.coalesce("ok", F.lit(False)), F.coalesce("passed", F.lit(False))
    truth = F.contains("adder", F.lit(TRUTH))
    by_truth = {"": F.lit(True), "_gt": truth, "_non_gt": F.coalesce(~truth, F.lit(True))}
    solved, failed = F.count_if("ok"), F.count_if(~F.col("ok"))
    made: list[Column] = [
        F.count("*").alias("problems"),
        solved.alias("solves"),
        failed.alias("fails"),
        F.coalesce(solved / F.nullif(solved + failed, F.lit(0)), F.lit(0.0)).alias("pass_at_1"),
        F.count_if(passed & F.coalesce("patched", F.lit(False))).alias("patched"),
        F.count_if(passed).alias("pass_all"),
        F.count_if(passed & ok).alias("pass_all_solved"),
        F.count_if(passed & F.col("adder").isNotNull() & ~truth).alias("pass_not_gt"),
        F.count_if(passed & ~ok & truth).alias("patched_gt"),
        F.count_if(passed & ~ok & F.coalesce(~truth, F.lit(True))).alias("patched_non_gt"),
    ]
    measures = {
        "base_chars": (F.length("base"), passed),
        "fix_chars": (F.length("fix"), passed),
        "base_comments": (F.col("_base.comments"), passed),
        "fix_comments": (F.col("_fix.comments"), passed),
        "base_lines": (F.col("_base.lines") - F.col("_base.comments"), passed),
        "fix_lines": (F.col("_fix.lines") - F.col("_fix.comments"), passed),
        "tokens": (F.col("tokens"), passed),
    }
    for tail, of in by_truth.items():
        measures[f"changed{tail}"] = (F.col("changed"), passed & ~ok & of)
        measures[f"changed_share{tail}"] = (F.try_divide("changed", "tokens"), passed & ~ok & of)
    for name, (value, when) in measures.items():
        own = F.when(when, value.cast("double"))
        made += [F.avg(own).alias(f"{name}_mean"), F.percentile(own, F.lit(0.5)).alias(f"{name}_median")]
    return rows.rollup(dataset).agg(*made).withColumn(dataset, F.coalesce(dataset, F.lit("TOTAL")))


def adder_stats(candidates: DataFrame, problem: str = "problem_id", adder: str = "adder", passed: str = "passed", distance: str = "distance") -> DataFrame:
    """(adder, passed, failed, chosen, unique, distance_mean, distance_median, added): what each adder did for the problems.

    A problem's candidates are first summed up by adder. chosen: the passing one
    with the least distance (ties by name); unique: no other adder passes;
    added: by how much the least passing distance of the problems would grow
    without the adder (problems that nobody else solves don't count).
    """
    best = F.min(F.when(F.col(passed), F.col(distance)))
    own = candidates.groupBy(problem, adder).agg(F.count_if(passed).alias("_p"), F.count_if(~F.col(passed)).alias("_f"), best.alias("_d"))
    order = Window.partitionBy(problem).orderBy(F.asc_nulls_last("_d"), adder)
    ranked = own.withColumns({"_r": F.row_number().over(order), "_next": F.lead("_d").over(order), "_solvers": F.count("_d").over(Window.partitionBy(problem))})
    first = (F.col("_r") == 1) & F.col("_d").isNotNull()
    sums = ranked.groupBy(adder).agg(
        F.sum("_p").alias("passed"),
        F.sum("_f").alias("failed"),
        F.count_if(first).alias("chosen"),
        F.count_if(first & (F.col("_solvers") == 1)).alias("unique"),
        F.coalesce(F.sum(F.when(first, F.col("_next") - F.col("_d"))), F.lit(0.0)).alias("added"),
    )
    spread = candidates.groupBy(adder).agg(F.avg(distance).alias("distance_mean"), F.percentile(distance, F.lit(0.5)).alias("distance_median"))
    return sums.join(spread, adder)
