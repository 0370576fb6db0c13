"""Reading and writing tables, and results kept by what made them."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_parquet(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None if there is none."""
    return spark.read.parquet(path) if exists(spark, path) else None


def read_csv(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """All CSV files that match, with headers, by the given schema."""
    return spark.read.csv(pattern, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, codec: str = "zstd", by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").option("compression", codec).partitionBy(*by).parquet(path)


def config_key(config: dict) -> str:
    """A short key of a configuration: equal configurations have equal keys, whatever their order."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def materialize(spark: SparkSession, folder: str, config: dict, make: Callable[[], DataFrame], fuller: Sequence[tuple[dict, Callable[[DataFrame], DataFrame]]] = ()) -> DataFrame:
    """The table that this configuration made before; else what a fuller configuration's table is cut down to; else make. What is new is kept.

    fuller: configurations whose tables hold all that is asked, each with what
    cuts its table down; the first that is there serves, and its key stands
    beside the new table (`derived_from`). A table appears under its name only
    when it is whole: of several writers the first to finish gives the table,
    the others' copies go.
    """
    path = _kept_at(folder, config)
    if not exists(spark, f"{path}/_SUCCESS"):
        parent = next(((c, cut) for c, cut in fuller if exists(spark, f"{_kept_at(folder, c)}/_SUCCESS")), None)
        made = make() if parent is None else parent[1](spark.read.parquet(_kept_at(folder, parent[0])))
        draft = f"{folder.rstrip('/')}/.draft-{uuid.uuid4().hex}"
        made.write.option("parquet.summary.metadata.level", "NONE").parquet(draft)
        note = {"config": config, "derived_from": None if parent is None else config_key(parent[0])}
        spark.createDataFrame([(json.dumps(note, sort_keys=True, default=str),)], "note string").coalesce(1).write.text(f"{draft}/_derivation")
        if not _renamed(spark, draft, path):
            _removed(spark, draft)
    return spark.read.parquet(path)


def derived_from(spark: SparkSession, folder: str, config: dict) -> str | None:
    """The key of the fuller configuration from whose table this one's was cut; None if it was made as such."""
    note = spark.read.text(f"{_kept_at(folder, config)}/_derivation").first()[0]
    return json.loads(note)["derived_from"]


def _kept_at(folder: str, config: dict) -> str:
    return f"{folder.rstrip('/')}/{config_key(config)}"


def _renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Give a folder its name, if no other has that name: one step for all who look."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    source, target = hadoop.Path(old), hadoop.Path(new)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(source), files.makeQualified(target), options)
        return True
    except Py4JJavaError:
        if files.exists(target):
            return False
        raise


def _removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tagged_union(parts: dict[str, DataFrame], tag: str = "src") -> DataFrame:
    """All rows of the parts, each with the part's name; columns that a part lacks are null."""
    out: DataFrame | None = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no parts")
    return out


def widened(df: DataFrame, schema: StructType) -> DataFrame:
    """df with all columns of a wider schema, in its order and types; what df lacks is null, what it has beyond it comes behind."""
    own = set(df.columns)
    wide = [(F.col(f"`{f.name}`") if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*wide, *[F.col(f"`{c}`") for c in df.columns if c not in set(schema.names)])


def subset(df: DataFrame, ids: DataFrame, key: str, order: str) -> DataFrame:
    """The rows whose key is in ids, with the place that ids gives them."""
    return df.join(ids.select(key, order), key)


def flat(df: DataFrame, sep: str = "__") -> DataFrame:
    """Nested structs as columns named by their path."""

    def walk(schema: StructType, path: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        for f in schema.fields:
            at = (*path, f.name)
            out += walk(f.dataType, at) if isinstance(f.dataType, StructType) else [F.col(".".join(f"`{p}`" for p in at)).alias(sep.join(at))]
        return out

    return df.select(*walk(df.schema, ()))


def zipped(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a and b side by side; a row that the other side lacks fails the job."""
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), on, "full")
    return both.withColumn("_a", F.when(F.col("_a") & F.col("_b"), F.lit(True)).otherwise(F.raise_error(F.lit("tables differ in their rows")).cast("boolean"))).where("_a").drop("_a", "_b")


def looked_up(asked: DataFrame, known: DataFrame, name: str, key: str, value: str, clean: Callable[[Column], Column]) -> DataFrame:
    """asked with the value of its exact key, or else of its cleaned key, and `how` it was found; the rows keep their own order column.

    Of several rows of known with the same key, or the same cleaned key, the
    least value counts, so that no row of asked comes twice.
    """
    exact = known.groupBy(F.col(key).alias(name)).agg(F.min(value).alias("_exact"))
    cleaned = known.groupBy(clean(F.col(key)).alias(name)).agg(F.min(value).alias("_cleaned"))
    both = asked.join(exact, name, "left").join(cleaned, name, "left")
    return both.withColumn(value, F.coalesce("_exact", "_cleaned")).withColumn("how", F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_cleaned").isNotNull(), "cleaned").otherwise("none")).drop("_exact", "_cleaned")


def renamed_by(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """df with all column names put through the regular expressions in turn."""
    names = df.columns
    for pattern, to in rules:
        names = [re.sub(pattern, to, n) for n in names]
    return df.toDF(*names)


def seeded_take(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a hash of key and seed (column _key), the same in every run."""
    return df.withColumn("_key", F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))).orderBy("_key", key).limit(n)


def dev_sample(df: DataFrame, key: str, share: float) -> DataFrame:
    """A share of the rows by a hash of their key: a small copy of a kept table for development, the same in every run."""
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_000)) < int(share * 1_000_000))


def literal_problem(spark: SparkSession, problem_id: str, base_text: str, fix_text: str, base_success: bool) -> DataFrame:
    """A problem's row from what was typed in."""
    return spark.createDataFrame([(problem_id, base_text, fix_text, base_success)], "problem_id string, base_text string, fix_text string, base_success boolean")


def synthetic_predictions(spark: SparkSession, n: int, seed: int = 7) -> DataFrame:
    """(problem_id, p, y) of n problems with uniform p and labels by a coin, from hashes of number and seed."""
    draw = lambda s: F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{s}")).cast("binary")), 1, 8), 16, 10).cast("long")
    return spark.range(n).select(F.col("id").alias("problem_id"), (draw(seed) / 4294967296.0).alias("p"), (draw(seed + 1) % 2).alias("y"))
