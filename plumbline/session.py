"""Session helpers shared by the queries, the tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plumbline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PLUMBLINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return importable(spark)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which all nodes share; where that is unset, a local master gets a temporary one, and any other an error."""
    key = "spark.checkpoint.dir"
    at = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {key} to a folder that all nodes share")
        at = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
        spark.conf.set(key, at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver found it."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files from which on rows are dealt in parts of a given size, and bytes of each part.
LARGE, PART = 64 << 20, 8 << 20


def parts(df: DataFrame) -> int | None:
    """Into how many parts the rows of df, a table of files, are dealt, so that a task's share stays the same however large they are; None for small ones.

    A number that is given stays: Spark joins parts of the other kind up by
    their size before they are taken apart or summed up.
    """
    bytes_ = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if bytes_ < LARGE:
        return None
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-bytes_ // PART))


def dealt(df: DataFrame, n: int | None, key: str) -> DataFrame:
    """df dealt by key into n parts; as it is, if there is no number."""
    return df if n is None else df.repartition(n, key)


def kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder: it is worked out once, and a lost executor costs only its tasks."""
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
