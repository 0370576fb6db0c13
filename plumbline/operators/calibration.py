"""Calibration and ranking metrics of probabilities against 0/1 labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expr import bin_of, brier, linspace, logit, ratio


def scores(df: DataFrame, keys: list[str], p: str = "p", y: str = "y", n: str | None = None) -> DataFrame:
    """Rows summed up by (keys, p): n and pos. All metrics below can be had from these, so wide data is read once.

    n: the column with the number of rows that a row of df stands for (y then is their sum), if df is summed up already.
    """
    count = F.count("*") if n is None else F.sum(n)
    return df.groupBy(*keys, F.col(p).alias("p")).agg(count.alias("n"), F.sum(F.col(y).cast("long")).alias("pos"))


def bins(df: DataFrame, keys: list[str], edges: list[float] | None = None, p: str = "p", y: str = "y", keep_empty: bool = False) -> DataFrame:
    """keys, bin, n, conf (mean probability), acc (share of ones), variance acc(1-acc), gap |conf-acc| of each bin.

    Empty bins have no row, or with keep_empty a row with n 0 and nulls.
    """
    edges = edges or linspace(10)
    found = df.groupBy(*keys, bin_of(F.col(p), edges).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc"))
    if keep_empty:
        grid = df.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2)))).withColumn("bin", F.col("bin").cast("long"))
        found = grid.join(found, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return found.withColumn("variance", F.col("acc") * (1 - F.col("acc"))).withColumn("gap", F.abs(F.col("conf") - F.col("acc")))


def bucket_of(p: Column) -> Column:
    """A bucket of p that never falls as p grows: 1/500 wide, and finer towards 0 and 1, where calibrated probabilities crowd. There are about 1 060."""
    return (F.floor(500 * p) + F.floor(20 * logit(p))).cast("long")


def running(small: DataFrame, keys: list[str], columns: list[str], p: str = "p") -> DataFrame:
    """small with before_<column> and all_<column>: each column's sum over the key's rows with smaller p, and over all of the key's.

    Sums run within buckets of p (see bucket_of) and over the buckets' totals,
    so no task needs all rows of a key; the totals are joined back.
    """
    small = small.withColumn("_bucket", bucket_of(F.col(p)))
    totals = small.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    totals = totals.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_offset_{c}") for c in columns], *[F.sum(f"_{c}").over(every).alias(f"all_{c}") for c in columns])
    inside = Window.partitionBy(*keys, "_bucket").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    summed = small.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_inside_{c}") for c in columns])
    joined = summed.join(totals, [*keys, "_bucket"])
    sums = [(F.col(f"_inside_{c}") + F.col(f"_offset_{c}")).alias(f"before_{c}") for c in columns]
    return joined.select(*[c for c in small.columns if c != "_bucket"], *sums, *[f"all_{c}" for c in columns])


def quantile_bins(df: DataFrame, keys: list[str], n_bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Like `bins`, with edges at exact linear percentiles of each group: a value on an edge falls into the bin above.

    The percentiles are read off running counts of the distinct probabilities,
    and the bins are summed up from these: rows are read once.
    """
    small = running(scores(df, keys, p, y), keys, ["n"])
    cuts = []
    for i in range(1, n_bins):
        at = F.lit(i / n_bins) * (F.col("all_n") - 1)
        at_row = lambda k: F.max(F.when((F.col("before_n") <= k) & (k < F.col("before_n") + F.col("n")), F.col("p")))
        low, high = at_row(F.floor(at)), at_row(F.ceil(at))
        share = F.max(at - F.floor(at))
        cuts.append((low + (high - low) * share).alias(f"_q{i}"))
    edges = small.groupBy(*keys).agg(*cuts)
    at = sum(((F.col("p") >= F.col(f"_q{i}")).cast("int") for i in range(1, n_bins)), F.lit(0))
    joined = small.join(edges, keys) if keys else small.crossJoin(F.broadcast(edges))
    found = joined.groupBy(*keys, at.cast("long").alias("bin")).agg(F.sum("n").alias("n"), (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("conf"), (F.sum("pos") / F.sum("n")).alias("acc"))
    return found.withColumn("gap", F.abs(F.col("conf") - F.col("acc")))


def equal_count_bins(df: DataFrame, keys: list[str], order: list[str], n_bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """keys, bin (from 1), n, conf, acc, lo, hi of bins of equal counts along p; order breaks ties.

    Running counts of the distinct probabilities tell where the bins' borders
    fall. Only rows of a probability that a border divides are ranked by order
    (n_bins - 1 probabilities of a key at most); all others go by their sums.
    """
    small = running(scores(df, keys, p, y), keys, ["n"])
    size, more = F.floor(F.col("all_n") / n_bins), F.col("all_n") % n_bins  # the first `more` bins have one row more

    def bin_at(row: Column) -> Column:
        return F.when(row < more * (size + 1), F.floor(row / (size + 1))).otherwise(more + F.floor((row - more * (size + 1)) / F.greatest(size, F.lit(1)))).cast("long") + 1

    first, last = bin_at(F.col("before_n")), bin_at(F.col("before_n") + F.col("n") - 1)
    placed = small.withColumn("bin", first).withColumn("_last", last)
    sums = [F.sum("n").alias("n"), F.sum(F.col("p") * F.col("n")).alias("_p"), F.sum("pos").alias("pos"), F.min("p").alias("lo"), F.max("p").alias("hi")]
    whole = placed.where("bin = _last").groupBy(*keys, "bin").agg(*sums)
    divided = placed.where("bin < _last").select(*keys, "p", "before_n", "all_n")
    rows = df.select(*keys, F.col(p).alias("p"), F.col(y).cast("long").alias("pos"), F.struct(*order).alias("_order"), F.lit(1).cast("long").alias("n")).join(divided, [*keys, "p"])
    ranked = rows.withColumn("_row", F.col("before_n") + F.row_number().over(Window.partitionBy(*keys, "p").orderBy("_order")) - 1)
    parts = ranked.withColumn("bin", bin_at(F.col("_row"))).groupBy(*keys, "bin").agg(*sums)
    return whole.union(parts).groupBy(*keys, "bin").agg(
        F.sum("n").alias("n"), (F.sum("_p") / F.sum("n")).alias("conf"), (F.sum("pos") / F.sum("n")).alias("acc"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def bin_edges(equal: DataFrame, keys: list[str]) -> DataFrame:
    """The upper edge of each equal-count bin: midway to the next bin's least value, 1 for the last."""
    order = Window.partitionBy(*keys).orderBy("bin")
    return equal.withColumn("edge", F.coalesce((F.col("hi") + F.lead("lo").over(order)) / 2, F.lit(1.0)))


def rms_error(binned: DataFrame, keys: list[str]) -> DataFrame:
    """Root of the mean squared gap, bins weighed by their counts."""
    gap = F.col("conf") - F.col("acc")
    return binned.groupBy(*keys).agg(F.sqrt(F.sum(F.col("n") * gap * gap) / F.sum("n")).alias("rms_error"))


def ece(df: DataFrame, keys: list[str], edges: list[float] | None = None, p: str = "p", y: str = "y") -> DataFrame:
    """Expected calibration error: gaps weighed by the bins' shares."""
    return bins(df, keys, edges, p, y).groupBy(*keys).agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("ece"))


def auc(df: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Area under the ROC curve, ties counted half; null if a group has one class only."""
    return metrics(df, keys, p=p, y=y).select(*keys, "auc")


def metrics(df: DataFrame, keys: list[str], edges: list[float] | None = None, p: str = "p", y: str = "y", n: str | None = None) -> DataFrame:
    """keys, n, base_rate, brier, ref_brier, bss, ece, auc: one scan, two shuffles of distinct probabilities.

    The Brier reference predicts the base rate; bss is null where that is
    without error, auc where there is one class only. Ranks run within buckets
    of probabilities (see bucket_of), then over the buckets' sums.
    """
    edges = edges or linspace(10)
    small = scores(df, keys, p, y, n).withColumn("_bucket", bucket_of(F.col("p")))
    below = Window.partitionBy(*keys, "_bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    neg = F.col("n") - F.col("pos")
    ranked = small.withColumn("_below", F.coalesce(F.sum(neg).over(below), F.lit(0))).withColumn("_bin", bin_of(F.col("p"), edges))
    by_part = ranked.groupBy(*keys, "_bucket", "_bin").agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("pos"),
        F.sum(F.col("p") * F.col("n")).alias("_p"),
        F.sum(F.col("pos") * (1 - F.col("p")) * (1 - F.col("p")) + neg * F.col("p") * F.col("p")).alias("_sq"),
        F.sum(F.col("pos") * (F.col("_below") + neg / 2)).alias("_rank"),
    )
    smaller = Window.partitionBy(*keys).orderBy("_bucket").rangeBetween(Window.unboundedPreceding, -1)  # a row for each bucket and bin
    by_part = by_part.withColumn("_rank", F.col("_rank") + F.col("pos") * F.coalesce(F.sum(neg).over(smaller), F.lit(0)))
    by_bin = by_part.groupBy(*keys, "_bin").agg(*[F.sum(c).alias(c) for c in ("n", "pos", "_p", "_sq", "_rank")])
    n, pos = F.sum("n"), F.sum("pos")
    base = pos / n
    return (
        by_bin.groupBy(*keys)
        .agg(n.alias("n"), base.alias("base_rate"), (F.sum("_sq") / n).alias("brier"), (base * (1 - base)).alias("ref_brier"), (F.sum(F.abs(F.col("_p") - F.col("pos"))) / n).alias("ece"), ratio(F.sum("_rank"), pos.cast("double") * (n - pos)).alias("auc"))
        .withColumn("bss", F.try_divide(F.col("ref_brier") - F.col("brier"), F.col("ref_brier")))
    )


def with_total(df: DataFrame, key: str, name: str = "TOTAL", compute=metrics, **options) -> DataFrame:
    """compute over each value of the key and over all rows, in a row named `name`; both share the scan."""
    small = df.select(F.explode(F.array(F.col(key).cast("string"), F.lit(name))).alias(key), *[c for c in df.columns if c != key])
    return compute(small, [key], **options)


def curves(df: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """ROC and PR points at each distinct probability as threshold: keys, threshold, tp, fp, tpr, fpr, precision, recall."""
    small = running(scores(df, keys, p, y).withColumn("neg", F.col("n") - F.col("pos")), keys, ["pos", "neg"])
    points = small.select(*keys, F.col("p").alias("threshold"), (F.col("all_pos") - F.col("before_pos")).alias("tp"), (F.col("all_neg") - F.col("before_neg")).alias("fp"), F.col("all_pos").alias("_p"), F.col("all_neg").alias("_n"))
    return points.select(*keys, "threshold", "tp", "fp", ratio(F.col("tp"), F.col("_p")).alias("tpr"), ratio(F.col("fp"), F.col("_n")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("_p")).alias("recall"))


def best_f1(df: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """The point of `curves` with the largest F1 (the smallest threshold of several), for each group."""
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    return curves(df, keys, p, y).withColumn("f1", f1).where("f1 is not null").groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def log_loss(p: Column, y: Column, clip: float = 1e-15) -> Column:
    c = F.greatest(F.lit(clip), F.least(p, F.lit(1 - clip)))
    return -F.avg(y * F.log(c) + (1 - y) * F.log(1 - c))


def classification(df: DataFrame, keys: list[str], threshold: float = 0.5, p: str = "p", y: str = "y") -> DataFrame:
    """Accuracy, precision, recall, F1 at a threshold (0 where undefined) and the share of ones."""
    yes, one = F.col(p) >= threshold, F.col(y) == 1
    tp, pp, ap = F.count_if(yes & one), F.count_if(yes), F.count_if(one)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(ratio(tp, pp)), zero(ratio(tp, ap))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        (F.count_if(yes == one) / F.count("*")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        zero(F.try_divide(2 * precision * recall, precision + recall)).alias("f1"),
        F.avg(F.col(y).cast("double")).alias("positive_rate"),
    )


def per_problem(df: DataFrame, problem: str = "problem_id", p: str = "p", y: str = "y") -> DataFrame:
    """Each problem's n, Brier score, gap of means, and skill over predicting the rate of all rows."""
    rate = df.agg(F.avg(F.col(y).cast("double")).alias("_rate"))  # one row
    r = F.col("_rate")
    out = df.crossJoin(F.broadcast(rate)).groupBy(problem).agg(F.count("*").alias("n"), brier(F.col(p), F.col(y)).alias("brier"), F.abs(F.avg(p) - F.avg(F.col(y).cast("double"))).alias("gap"), F.avg((r - F.col(y)) * (r - F.col(y))).alias("_ref"))
    return out.withColumn("skill", F.try_divide(F.col("_ref") - F.col("brier"), F.col("_ref"))).drop("_ref")


def histogram(df: DataFrame, keys: list[str], n_bins: int = 10, p: str = "p") -> DataFrame:
    """keys, bin, lo, hi, n of equal bins of [0, 1]; bins without rows have n = 0."""
    found = df.groupBy(*keys, bin_of(F.col(p), linspace(n_bins)).cast("long").alias("bin")).agg(F.count("*").alias("_n"))
    every = found.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1)))).withColumn("bin", F.col("bin").cast("long"))
    return every.join(found, [*keys, "bin"], "left").select(*keys, "bin", (F.col("bin") / n_bins).alias("lo"), ((F.col("bin") + 1) / n_bins).alias("hi"), F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def summary(p: Column, y: Column) -> Column:
    """An aggregate: how many predictions, their Brier score and the base rate as one text."""
    return F.format_string("%d predictions, Brier %.4f, base rate %.4f", F.count("*"), F.round(F.avg((p - y) * (p - y)), 4), F.round(F.avg(y.cast("double")), 4))


def concentration(df: DataFrame, keys: list[str], error: str, shares: dict[str, float]) -> DataFrame:
    """keys and for each name the part of the errors (in [0, 1]) that the worst floor(share * n) rows make up.

    Rows are summed up by error (nine digits), and running counts from the
    largest tell how many rows of each error are among the worst.
    """
    small = df.groupBy(*keys, F.round(error, 9).alias("p")).agg(F.count("*").alias("n"), F.sum(error).alias("s"))
    small = running(small, keys, ["n"])
    worse = F.col("all_n") - F.col("before_n") - F.col("n")

    def part(share: float) -> Column:
        taken = F.greatest(F.lit(0), F.least(F.col("n"), F.floor(F.lit(share) * F.col("all_n")) - worse))
        return F.try_divide(F.sum(F.col("s") * taken / F.col("n")), F.sum("s"))

    return small.groupBy(*keys).agg(*[part(x).alias(name) for name, x in shares.items()])


def bin_summary(binned: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bins, mean_accuracy and mean_variance (accuracy times its complement) over the bins that have rows, each bin counting once, and the largest gap."""
    full = binned.where("n > 0")
    return full.groupBy(*keys).agg(F.count("*").alias("bins"), F.avg("acc").alias("mean_accuracy"), F.avg(F.col("acc") * (1 - F.col("acc"))).alias("mean_variance"), F.max("gap").alias("largest_gap"))


def model_summary(df: DataFrame, keys: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """keys, n, brier, ece, auc, log_loss and best_f1: a row for each model. Each part sums up distinct probabilities first; only rows of keys are joined."""
    whole = metrics(df, keys, p=p, y=y).select(*keys, "n", "brier", "ece", "auc")
    losses = df.groupBy(*keys).agg(log_loss(F.col(p), F.col(y)).alias("log_loss"))
    best = best_f1(df, keys, p, y).select(*keys, F.col("f1").alias("best_f1"))
    return whole.join(losses, keys).join(best, keys)
