"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import shared_folder

class Scratch:
    """A folder of its own for the intermediate tables of one call.

    A written table cuts lineage: a lost executor costs the tasks that it ran,
    and several readers share one computation.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, shared_folder(spark, name)
        self.count = 0

    def keep(self, df: DataFrame, name: str = "table") -> DataFrame:
        self.count += 1
        path = f"{self.at}/{self.count}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, df: DataFrame) -> None:
        """Delete a kept table that nothing will read again."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
