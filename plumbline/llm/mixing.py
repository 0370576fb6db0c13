"""Temperature mixing of sources, realised as budgeted block permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.columns import set_aside
from plumbline.llm.scratch import Scratch

#: Exponents that one pass over the sources tries, and passes: the exponent is found to (SECTIONS - 1) ** -PASSES.
SECTIONS, PASSES = 17, 5

#: Rows of a table of sources or blocks up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 50_000

#: What stands for a source that is null, only while rows are grouped and joined.
_NULL = "\u0000null"


def token_count(text: Column) -> Column:
    """Words of a text and one for its end (null: an end only)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def weights(sources: DataFrame, entropy: float | None = None, repetition: float | None = None, cover: bool = False) -> DataFrame:
    """sources (source, tokens) with share, exponent, weight and the weight's entropy.

    A source's weight is share ** exponent, normalised. The exponent in [0, 1]
    is bisected (in sections, each a pass over the sources) to the largest for
    which the weights' entropy reaches `entropy` (a part of the greatest
    possible, 0 to 1), or to the smallest for which no source is read more than
    `repetition` times in a budget of all tokens (with `cover`, so many times as
    often as any other source). If even exponent 0 misses the
    entropy it is 0; if even 1 misses the repetitions it is 1. Sources without
    tokens have weight 0.
    """
    spark = sources.sparkSession
    whole = sources.agg(F.sum("tokens").alias("_all"), F.count_if(F.col("tokens") > 0).alias("_n"))
    shares = sources.crossJoin(whole).withColumn("share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("_all")), F.lit(0.0)))  # one row on the right
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        tried = [low + (high - low) * i / (SECTIONS - 1) for i in range(SECTIONS)]
        power = F.pow("share", F.col("x"))
        found = (
            shares.where("share > 0")
            .withColumn("x", F.explode(F.array(*[F.lit(x) for x in tried])))
            .groupBy("x")
            .agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("s"), F.max(power / F.col("share")).alias("r"), F.min(power / F.col("share")).alias("least"), F.max("_n").alias("n"))
            .select("x", (F.log("z") - F.col("x") * F.col("s") / F.col("z")).alias("entropy"), (F.col("r") / (F.col("least") if cover else F.col("z"))).alias("repetition"), "n")
            .orderBy("x")
            .collect()  # a row for each exponent tried
        )
        if not found:
            break
        if entropy is not None:
            goal = entropy * spark.range(1).select(F.log(F.lit(float(found[0].n)))).first()[0] - 1e-12
            good = [r.x for r in found if r.entropy >= goal]
            low, high = (good[-1], min([x for x in tried if x > good[-1]], default=high)) if good else (0.0, 0.0)
        else:
            good = [r.x for r in found if r.repetition <= (repetition or 1.0) + 1e-12]
            low, high = (max([x for x in tried if x < good[0]], default=low), good[0]) if good else (1.0, 1.0)
        if low == high:
            break
    exponent = low if entropy is not None else high
    raw = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0)
    powers = shares.withColumn("_w", raw)
    total = powers.agg(F.sum("_w").alias("_z"))
    return powers.crossJoin(total).select("source", "tokens", "share", F.lit(exponent).alias("exponent"), F.coalesce(F.try_divide("_w", "_z"), F.lit(0.0)).alias("weight"))


def mix(
    docs: DataFrame,
    entropy: float | None = None,
    repetition: float | None = 2.0,
    budget: int | None = None,
    cover: bool = False,
    block_tokens: int = 1_000_000,
    seed: int = 42,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """docs as often as the mixture wants each row, with the columns _tokens, _weight, _epoch, _block and _order.

    Sources get the weights of `weights`, and of the budget in tokens (all
    tokens of docs, if not given) their share. With `cover` the budget is raised
    until it holds every source once, so no document is left out, and the
    repetition limit counts against the source that is read least. A source's
    documents are dealt into blocks of about `block_tokens` tokens; each epoch
    of the source goes through its blocks in another order. Full epochs take all
    blocks; the last takes blocks in its order while they fit, and of the next
    block documents in a fixed order while they fit. Sorting by _order
    interleaves the sources in proportion over the budget.

    A null source is a source of its own. Null and empty texts count one token
    (their end). Repeated rows count each; of rows alike in all of id, source
    and text, which comes first in a cut block is all the same. An empty table
    gives no rows. Other columns pass through, whatever their names; one named
    like an added column comes back with _in behind its name.
    """
    docs, names, back = set_aside(docs)
    source_col, id_col, text_col = names[source_col], names[id_col], names[text_col]
    rows = docs.withColumn("_source", F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL))).withColumn("_tokens", token_count(F.col(text_col)))
    scratch = Scratch(docs.sparkSession, "mixing")
    totals = scratch.keep(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_tokens").alias("tokens")), "sources")
    goal = weights(totals, entropy=entropy, repetition=None if entropy is not None else repetition, cover=cover)
    whole = goal.agg(F.sum("tokens").alias("_all"), F.max(F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight"))).alias("_cover"))
    size = F.coalesce(F.lit(budget).cast("double"), F.col("_all").cast("double"))
    size = F.greatest(size, "_cover") if cover else size
    plan = goal.crossJoin(whole).select(
        F.col("source").alias("_source"),
        F.col("tokens").alias("_span"),
        F.col("weight").alias("_weight"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("int").alias("_blocks"),
        (F.col("weight") * size).alias("_take"),
    )
    # a hair over a whole number of epochs is that number
    plan = plan.withColumn("_epochs", F.floor(F.col("_take") / F.col("_span") + 1e-9).cast("int")).withColumn("_rest", F.greatest(F.lit(0.0), F.col("_take") - F.col("_epochs") * F.col("_span")))

    plan = scratch.keep(plan, "plan")
    n_sources, n_blocks = plan.agg(F.count("*"), F.coalesce(F.sum("_blocks"), F.lit(0))).first()
    small = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df

    key = F.xxhash64(F.col(id_col).cast("string"), F.xxhash64(text_col), F.lit(seed))
    placed = rows.join(small(plan, n_sources), "_source").withColumn("_block", F.pmod(key, F.col("_blocks")).cast("int"))
    turn = lambda epoch: F.pmod(F.xxhash64("_source", "_block", epoch, F.lit(seed)), F.lit(1 << 30))
    by_source = Window.partitionBy("_source").orderBy(turn("_epochs"), "_block")
    blocks = (
        placed.groupBy("_source", "_block", "_epochs", "_rest")
        .agg(F.sum("_tokens").alias("_size"))
        .withColumn("_before", F.sum("_size").over(by_source.rowsBetween(Window.unboundedPreceding, -1)))
        .select("_source", "_block", (F.col("_rest") - F.coalesce("_before", F.lit(0))).alias("_left"), "_size")
    )
    blocks = scratch.keep(blocks, "blocks")
    placed = placed.join(small(blocks, n_blocks), ["_source", "_block"])
    # one block for each source is cut: documents in a fixed order, while they fit
    cut = placed.where("_left > 0 and _left < _size").select("_source", "_block", key.alias("_key"), "_tokens", "_left")
    inside = Window.partitionBy("_source", "_block").orderBy("_key")
    fits = cut.groupBy("_source", "_block", "_key", "_left").agg(F.sum("_tokens").alias("_t")).withColumn("_sum", F.sum("_t").over(inside)).where("_sum <= _left")
    last = fits.groupBy("_source", "_block").agg(F.max("_key").alias("_until"))
    placed = placed.join(small(scratch.keep(last, "cuts"), n_sources), ["_source", "_block"], "left")
    extra = F.when(F.col("_left") <= 0, 0).when(F.col("_left") >= F.col("_size"), 1).otherwise(F.coalesce((key <= F.col("_until")).cast("int"), F.lit(0)))
    copies = F.col("_epochs") + extra
    out = placed.withColumn("_epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    # blocks of an epoch in the order of their hash, documents of a block by theirs, on a scale of the source's share of the budget
    inside_epoch = (turn("_epoch") + F.pmod(key, F.lit(1 << 30)) / float(1 << 30)) / float(1 << 30)
    place = (F.col("_epoch") + inside_epoch) * F.col("_span") / F.col("_take")
    return back(out.withColumn("_order", place), ["_tokens", "_weight", "_epoch", "_block", "_order"])
