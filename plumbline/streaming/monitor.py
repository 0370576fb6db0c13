"""A calibration monitor over a stream of scored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_folder
from plumbline.sources.tables import exists


def scored(events: DataFrame) -> DataFrame:
    """Events with p (value as a part of 100) and y (no error)."""
    p = F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", p.alias("p"), (F.col("event_type") != "error").cast("int").alias("y"))


def windows(rows: DataFrame, window: str) -> DataFrame:
    """start, event_type, n, base_rate and brier of each event type in each window; works on streams and tables alike."""
    d = F.col("p") - F.col("y")
    out = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("base_rate"), F.avg(d * d).alias("brier"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "base_rate", "brier")


def shown(found: DataFrame) -> DataFrame:
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("window_start"), "event_type", "n", "base_rate", "brier")


def summary(rows: DataFrame, window: str = "1 hour") -> DataFrame:
    """n, base_rate and brier of each event type in each window, by the window's first day."""
    return shown(windows(rows, window))


def stream(spark: SparkSession, path: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The windows of a growing folder (or glob) of event files: repeated event ids count once, rows later than `late` are left out."""
    schema = spark.read.parquet(path).schema
    rows = scored(spark.readStream.schema(schema).parquet(path)).withWatermark("ts", late)
    return windows(rows.dropDuplicatesWithinWatermark(["event_id"]), window)


def run_to_end(spark: SparkSession, path: str, window: str = "1 hour", late: str = "1 day", files: int | None = None) -> DataFrame:
    """What the stream has told when all files that are there have been read, `files` at a time (all at once, if that isn't said).

    Each batch writes only the windows that it changed, as a part of its own
    (written again if the batch is), in the folder that the cluster shares,
    beside the stream's checkpoint; windows older than the watermark leave the
    state, and so do ids older than `late`. Of a window the last batch's row
    counts.
    """
    folder = shared_folder(spark, "monitor")
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema)
    source = source if files is None else source.option("maxFilesPerTrigger", files)
    rows = scored(source.parquet(path)).withWatermark("ts", late)
    out = windows(rows.dropDuplicatesWithinWatermark(["event_id"]), window)

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/windows/batch={batch}")

    job = out.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    job.awaitTermination()
    if not exists(spark, f"{folder}/windows"):
        return shown(spark.createDataFrame([], out.schema))
    told = spark.read.schema(out.schema.add("batch", "long")).parquet(f"{folder}/windows")
    last = told.groupBy("start", "event_type").agg(F.max_by(F.struct("n", "base_rate", "brier"), "batch").alias("r"))
    return shown(last.select("start", "event_type", "r.*"))
