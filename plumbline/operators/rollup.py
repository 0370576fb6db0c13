"""Roll predictions up from tokens to lines and problems, and back down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expr import AGGREGATES
from plumbline.session import dealt


def to_lines(tokens: DataFrame, how: str = "gmean", keys: tuple[str, ...] = ("problem_id", "line_id"), p: str = "p", y: str = "y") -> DataFrame:
    """keys, p (aggregated by `how`), y (the least label: a line is right if all its tokens are), n."""
    return tokens.groupBy(*keys).agg(AGGREGATES[how](F.col(p)).alias("p"), F.min(y).alias("y"), F.count("*").alias("n"))


def to_problems(tokens: DataFrame, how: str = "gmean", keys: tuple[str, ...] = ("problem_id",), p: str = "p", label: Column | None = None) -> DataFrame:
    """keys, p, y of whole problems; label is an aggregate (the least token label, if not given)."""
    return tokens.groupBy(*keys).agg(AGGREGATES[how](F.col(p)).alias("p"), (F.min("y") if label is None else label).alias("y"), F.count("*").alias("n"))


def pre_aggregated(samples: DataFrame, how: str = "min", keys: tuple[str, ...] = ("problem_id", "line_id"), sample: str = "sample_id", keep: str = "keep") -> DataFrame:
    """Aggregate each sample over the line first, then take the mean over samples."""
    each = samples.groupBy(*keys, sample).agg(AGGREGATES[how](F.col(keep).cast("double")).alias("p"))
    return each.groupBy(*keys).agg(F.avg("p").alias("p"), F.count("*").alias("n"))


def sample_mean(samples: DataFrame, keys: tuple[str, ...] = ("problem_id", "pos"), keep: str = "keep") -> DataFrame:
    """The share of samples that keep each token."""
    return samples.groupBy(*keys).agg(F.avg(F.col(keep).cast("double")).alias("p"), F.count("*").alias("n"))


def to_tokens(tokens: DataFrame, line_probs: DataFrame, line: tuple[str, ...] = ("problem_id", "line_id"), problem: str = "problem_id", parts: int | None = None) -> DataFrame:
    """Each token with its line's probability (a row for each line); tokens of lines without one get the problem's mean over its lines.

    Both sides are dealt by problem once, into `parts` if given, and lie in one
    order: a line's row is seen by its tokens in windows, so nothing is joined.
    """
    keys = [*dict.fromkeys([problem, *line])]
    own = tokens.withColumns({"_of_line": F.lit(False), "line_p": F.lit(None).cast(line_probs.schema["line_p"].dataType)})
    known = line_probs.select(*keys, "line_p").withColumn("_of_line", F.lit(True))
    rows = dealt(own.unionByName(known, allowMissingColumns=True), parts, problem)
    mean = F.avg(F.when(F.col("_of_line"), F.col("line_p"))).over(Window.partitionBy(problem))
    found = F.max("line_p").over(Window.partitionBy(*keys))
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    made = rows.withColumns({"_found": F.when(~null, found), "_mean": F.when(F.col(problem).isNotNull(), mean)})
    return made.where("not _of_line").withColumn("line_p", F.coalesce("_found", "_mean")).select(*tokens.columns, "line_p")


def positive_counts(df: DataFrame, keys: list[str], problem: str = "problem_id", line: str = "line_id", y: str = "y") -> DataFrame:
    """keys, problems, tokens, positive, lines, positive_lines, right: tokens and lines (with all tokens positive) by keys, and over all keys as a row of nulls.

    Lines are summed up from their tokens, problems from their lines; the
    overall row comes from the same sums.
    """
    lines = df.groupBy(*keys, problem, line).agg(F.count("*").alias("_n"), F.sum(y).alias("_p"))
    problems = lines.groupBy(*keys, problem).agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"), F.count("*").alias("_l"), F.count_if(F.col("_p") == F.col("_n")).alias("_q"))
    return problems.rollup(*keys).agg(
        F.count("*").alias("problems"), F.sum("_n").alias("tokens"), F.sum("_p").alias("positive"), F.sum("_l").alias("lines"), F.sum("_q").alias("positive_lines"), F.count_if(F.col("_l") == F.col("_q")).alias("right")
    )


#: How the chance that all tokens of a problem are right is told from theirs.
ESTIMATORS = {"min": lambda p: F.min(p), "gmean": lambda p: F.when(F.min(p) <= 0, 0.0).otherwise(F.exp(F.avg(F.log(F.when(p > 0, p))))), "mean": lambda p: F.avg(p)}


def all_correct(problems: DataFrame, tokens: DataFrame, problem: str, p: str = "p", y: str = "y") -> DataFrame:
    """(problem, estimator, p, y, failed): the chance that all tokens are right by each of ESTIMATORS; y is the least of the tokens'.

    A problem without tokens failed: its chance is 0 and it counts as wrong.
    """
    sums = tokens.groupBy(problem).agg(*[f(F.col(p)).alias(k) for k, f in ESTIMATORS.items()], F.min(y).alias("_y"))
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("estimator"), F.col(k).alias("_e")) for k in ESTIMATORS])).alias("e")
    rows = problems.select(problem).join(sums, problem, "left").select(problem, "_y", named)
    return rows.select(problem, "e.estimator", F.coalesce("e._e", F.lit(0.0)).alias("p"), F.coalesce("_y", F.lit(0)).alias("y"), F.col("e._e").isNull().alias("failed"))
