from pyspark.sql import functions as F

from spikeframe.llm import common


def test_only_marked_with_the_first_and_last_bit(spark, monkeypatch):
    monkeypatch.setattr(common, "MARKS", 1 << 15)
    ids = spark.range(400_000).select(F.col("id").alias("_id"), F.lit(7).cast("long").alias("_th"), F.lit("text").alias("_text"))
    at = ids.withColumn("at", F.pmod(F.xxhash64("_id", "_th"), F.lit(1 << 15)))
    ends = {k: {r["_id"] for r in at.where(F.col("at") == k).collect()} for k in (0, (1 << 15) - 1)}
    assert all(ends.values())
    for k, same in ends.items():
        marked = ids.where(F.col("_id") == min(same)).select("_id", "_th")
        assert {r["_id"] for r in common.only_marked(ids, marked).collect()} == same
