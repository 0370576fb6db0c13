"""Linear probes on embedding vectors, and pooling of vectors by group."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.expr import hash_fold


def attention_pool(df: DataFrame, group: str, logit: str, value: str) -> DataFrame:
    """The mean of value weighed by the softmax of logit within each group."""
    top = df.groupBy(group).agg(F.max(logit).alias("_top"))  # pre-aggregated, so a large group isn't gathered
    w = df.join(top, group).withColumn("_w", F.exp(F.col(logit) - F.col("_top")))
    return w.groupBy(group).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("pooled"), F.count("*").alias("n"))


def multi_head_pool(df: DataFrame, group: str, row: str, heads: list[list[float]], vector: str = "embedding", salts: int = 32) -> DataFrame:
    """(group, head, i, pooled): for each head the mean of the vectors weighed by the softmax, within the group, of their product with the head.

    A group is dealt into `salts` parts by a hash of the rows' key. Each part is
    summed up against its own largest product, and the parts are put together
    by at most `salts` rows for each component, so that a group of any size is
    never in one task and no exponential overflows.
    """
    weights = [F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*map(F.lit, q)), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x) for q in heads]
    rows = df.select(group, F.pmod(F.xxhash64(F.col(row).cast("string")), F.lit(salts)).alias("_salt"), F.col(vector).alias("_v"), F.array(*weights).alias("_l"))
    part = Window.partitionBy(group, "_salt")
    rows = rows.withColumn("_top", F.array(*[F.max(F.get("_l", F.lit(h))).over(part) for h in range(len(heads))]))
    rows = rows.withColumn("_w", F.zip_with("_l", "_top", lambda x, top: F.exp(x - top)))
    cells = rows.select(group, "_salt", "_w", "_top", F.posexplode("_v").alias("i", "_x"))
    head = lambda c, h: F.get(c, F.lit(h))
    sums = cells.groupBy(group, "_salt", "i").agg(F.array(*[F.struct(F.max(head("_top", h)).alias("top"), F.sum(head("_w", h) * F.col("_x")).alias("a"), F.sum(head("_w", h)).alias("b")) for h in range(len(heads))]).alias("_s"))
    parts = sums.select(group, "_salt", "i", F.posexplode("_s").alias("head", "s")).groupBy(group, "head", "i").agg(F.collect_list("s").alias("_p"), F.max("s.top").alias("_m"))
    total = lambda c: F.aggregate("_p", F.lit(0.0), lambda a, s: a + F.exp(s["top"] - F.col("_m")) * s[c])
    return parts.select(group, "head", "i", (total("a") / total("b")).alias("pooled"))


def pooled(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """Mean and maximum of each component over the vectors of a group, as arrays.

    Vectors are unfolded to (group, component, value), so a large group is
    pre-aggregated where it lies.
    """
    parts = df.select(group, F.posexplode(F.col(vector)).alias("_i", "_v")).groupBy(group, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"), F.max(F.col("_v").cast("double")).alias("_t"))
    rows = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_i", "_m", "_t"))).alias("_c"))
    return rows.select(group, F.transform("_c", lambda c: c["_m"]).alias("mean"), F.transform("_c", lambda c: c["_t"]).alias("top"))


def shifted(df: DataFrame, key: str, pos: str, vector: str = "embedding") -> DataFrame:
    """Each vector followed by its predecessor's in the same key; the first by zeros."""
    before = F.lag(vector).over(Window.partitionBy(key).orderBy(pos))
    zeros = F.transform(F.col(vector), lambda x: x * 0)
    return df.withColumn(vector, F.concat(F.col(vector), F.coalesce(before, zeros)))


def linear(df: DataFrame, key: str, k: int = 5, vector: str = "embedding", y: str = "y", penalty: float = 0.01) -> DataFrame:
    """(key, fold, p, y): chances by logistic regressions, each fit on the other folds (by hash of the key)."""
    rows = df.select(key, y, array_to_vector(F.col(vector).cast("array<double>")).alias("features"), hash_fold(F.col(key), k).alias("fold"))
    rows = rows.withColumn("label", F.col(y).cast("double"))
    out = None
    for fold in range(k):
        model = LogisticRegression(maxIter=30, regParam=penalty).fit(rows.where(F.col("fold") != fold))
        part = model.transform(rows.where(F.col("fold") == fold)).select(key, "fold", vector_to_array("probability")[1].alias("p"), y)
        out = part if out is None else out.union(part)
    return out
