"""As-of joins and interval joins of ordered rows, with long keys split over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], at: str, carry: list[str], width: float, ties: list[str] | None = None, number: Column | None = None) -> DataFrame:
    """left with the columns carry of the last row of right that has the same key and doesn't lie behind it; null if there is none.

    Both sides are ordered once, in buckets of `width` of the place: within a
    bucket by a window, from bucket to bucket by the last row of each. So a key
    is split over as many tasks as it has buckets, and only a row for each key
    and bucket goes by the key alone.

    Rows of right at the very place count. Of several at one place the one with
    the largest `ties` (columns of right) is taken. Rows of left stay as often
    as they are; a null key or place finds nothing, rows of right with one are
    never found. number: the place as a number, if `at` isn't one.
    """
    ties = ties or []
    at_number = F.col(at) if number is None else number
    own = left.columns
    known = F.struct(at_number.alias("_at"), *ties, *[F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)])
    mine = F.struct(*own)
    keys = [F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)]
    names = [f"_by_{i}" for i in range(len(by))]
    usable = at_number.isNotNull()
    for c in by:
        usable = usable & F.col(c).isNotNull()
    found = right.where(usable).select(*keys, at_number.alias("_place"), F.lit(0).alias("_side"), known.alias("_known"))
    asked = left.select(*keys, at_number.alias("_place"), F.lit(1).alias("_side"), mine.alias("_mine"), usable.alias("_usable"))
    rows = found.unionByName(asked, allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_place") / width))
    order = Window.partitionBy(*names, "_bucket").orderBy("_place", "_side", "_known").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("_near", F.last("_known", ignorenulls=True).over(order)).where("_side = 1")
    lasts = rows.groupBy(*names, "_bucket").agg(F.max("_known").alias("_last"))
    carried = lasts.withColumn("_far", F.last("_last", ignorenulls=True).over(Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select(*names, "_bucket", "_far")
    both = seen.join(carried.where("_far is not null"), [*names, "_bucket"], "left")
    hit = F.when(F.col("_usable"), F.coalesce("_near", "_far"))
    return both.select("_mine.*", *[hit[f"_carry_{i}"].alias(c) for i, c in enumerate(carry)])


def overlaps(a: DataFrame, b: DataFrame, key: str, width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Rows of a and b of the same key whose [start, end) share a place; b's columns come as b_*.

    Intervals meet in the buckets of `width` places that they touch, and a pair
    is given by the first bucket that both touch, so that no pair comes twice
    and a long key is split over its buckets. Empty intervals meet nothing.
    """
    b = b.select(key, *[F.col(c).alias(f"b_{c}") for c in b.columns if c != key])

    def dealt(df: DataFrame, s: str, e: str) -> DataFrame:
        first, last = F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)
        return df.where(F.col(s) < F.col(e)).withColumn("_bucket", F.explode(F.sequence(first, last)))

    both = dealt(a, start, end).join(dealt(b, f"b_{start}", f"b_{end}"), [key, "_bucket"])
    first = F.floor(F.greatest(F.col(start), F.col(f"b_{start}")) / width)
    return both.where((F.col(start) < F.col(f"b_{end}")) & (F.col(f"b_{start}") < F.col(end)) & (F.col("_bucket") == first)).drop("_bucket")
