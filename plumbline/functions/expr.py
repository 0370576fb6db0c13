"""Column expressions: bins, means, scales and small text measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def linspace(n: int) -> list[float]:
    """n + 1 edges of n equal bins of [0, 1], as doubles that are products of the step (so 0.3 is 0.30000000000000004)."""
    step = 1.0 / n
    return [i * step for i in range(n)] + [1.0]


def bin_of(p: Column, edges: list[float]) -> Column:
    """Index of the bin [lo, hi) of p; the last bin is closed, and what lies outside falls into the first or last."""
    return reduce(lambda a, b: a + b, [(p >= F.lit(e)).cast("int") for e in edges[1:-1]], F.lit(0))


def gmean(x: Column) -> Column:
    """Geometric mean of non-negative values as an aggregate; one zero makes it zero."""
    return F.when(F.min(x) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.log(F.when(x > 0, x)))))


#: Rollup aggregates by name.
AGGREGATES = {"mean": F.avg, "gmean": gmean, "min": F.min, "max": F.max}


def logit(p: Column, clip: float = 1e-6) -> Column:
    """ln(p / (1 - p)) of p kept clip away from 0 and 1."""
    c = F.greatest(F.lit(clip), F.least(p, F.lit(1 - clip)))
    return F.log(c / (1 - c))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def shrink(p: Column, by: float = 0.001) -> Column:
    """p moved `by` towards one half."""
    return F.when(p < 0.5, p + by).otherwise(p - by)


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def rounded(df, digits: int = 6):
    """df with every double rounded; halves go away from zero."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- text ---


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def strip(text: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.regexp_replace(text, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def is_blank(line: Column) -> Column:
    return strip(line) == ""


def indent_of(line: Column) -> Column:
    """Leading blanks and tabs of a line."""
    return F.length(line) - F.length(F.regexp_replace(line, r"^[ \t]+", ""))


def hash_fold(key: Column, k: int) -> Column:
    """The first eight bytes of SHA-256 of the key, big-endian, modulo k."""
    digest = F.sha2(key.cast("string").cast("binary"), 256)
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long") % k
    return ((half(1) * (2**32 % k) + half(9)) % k).cast("int")


def truncated(text: Column, budget: int, mark: str = "\n...\n", head: float = 0.2) -> Column:
    """The text if it is at most budget long, else its first `head` part and its last, with the mark between, budget signs in all."""
    room = budget - len(mark)
    first = int(room * head)
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(F.substring(text, 1, first), F.lit(mark), F.substring(text, -(room - first), room - first)))


# --- maps and small rules ---


def merged_maps(*maps: Column) -> Column:
    """The union of maps; of equal keys the later map's value counts."""
    entries = F.concat(*[F.map_entries(m) for m in maps])
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.create_map(e["key"], e["value"])))


def map_get(m: Column, key: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def success(preset: Column, metric: Column) -> Column:
    """A preset outcome, or else the metric's; false where neither is known."""
    return F.coalesce(preset, metric, F.lit(False))


def digit(p: Column) -> Column:
    """A probability as a digit of 0 to 9."""
    return F.least(F.floor(p * 10), F.lit(9)).cast("long")
