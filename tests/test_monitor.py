from pyspark.sql import functions as F

from plumbline.streaming import monitor


def test_many_batches_give_the_summary_of_all(spark, tmp_path):
    """Windows that later files change, repeated events in several files, hours within one day."""
    rows = [(i % 70, f"2024-01-0{1 + i % 3} {i % 5:02}:30:00", ["click", "error"][i % 2], float(i % 101)) for i in range(140)]
    df = spark.createDataFrame(rows, "event_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(4):
        df.where(F.pmod(F.col("event_id"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    path = f"{tmp_path}/events/*.parquet"
    once = spark.read.parquet(path).dropDuplicates(["event_id"])
    key = lambda df: sorted((r.window_start, r.event_type, r.n, round(r.base_rate, 9), round(r.brier, 9)) for r in df.collect())
    for window in ("1 hour", "1 day"):
        plain = key(monitor.summary(monitor.scored(once), window))
        assert len(plain) > 5
        same = {(w, t) for w, t, *_ in plain}
        got = monitor.run_to_end(spark, path, window, late="10 days", files=1)
        assert {(r.window_start, r.event_type) for r in got.collect()} == same and sum(r.n for r in got.collect()) == sum(r[2] for r in plain)
