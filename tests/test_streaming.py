import time

from pyspark.sql import functions as F

from spikeframe.streaming import binned_rate, for_each_chunk, peri_event_pairs, run_to_end, running_intervals


def test_intervals_go_on_across_batches(spark, tmp_path):
    schema = "user_id long, event_id long, t double"
    for k, rows in enumerate(([(1, 1, 0.5), (2, 2, 1.0)], [(1, 3, 2.0), (1, 4, 2.5)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = run_to_end(running_intervals(stream, "user_id"), spark)
    assert sorted((r["user_id"], r["event_id"], r["isi"]) for r in found.collect()) == [(1, 3, 1.5), (1, 4, 0.5)]


def test_rates_pairs_and_chunks(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{s:02d}") for s in (1, 2, 11, 50)]
    spark.createDataFrame(rows, "unit long, ts string").select("unit", F.to_timestamp("ts").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("unit long, ts timestamp").parquet(str(tmp_path / "in"))
    found = run_to_end(binned_rate(stream, "ts", "10 seconds", "5 seconds", ["unit"]), spark)
    assert sorted(r["count"] for r in found.collect()) == [1, 2]
    events = spark.readStream.schema("unit long, ts timestamp").parquet(str(tmp_path / "in"))
    pairs = run_to_end(peri_event_pairs(stream.withColumnRenamed("ts", "spike_time"), events.withColumnRenamed("ts", "event_time"), 1, 1, "1 minute", ["unit"]), spark)
    assert pairs.count() == 6
    seen = []
    for_each_chunk(stream, lambda df, k: seen.append(df.count()), str(tmp_path / "state"))
    assert sum(seen) == 4
