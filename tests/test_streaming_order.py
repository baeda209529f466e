"""Late and mixed rows: a stream gives the rows of the whole table."""

import random
import time

from spikeframe.streaming.in_order import STATE_STORE, intervals_in_order, run_closed

SCHEMA = "unit long, event_id long, t double"


def by_loop(rows):
    out, last = [], {}
    for u, e, t in sorted((r for r in rows if r[2] is not None and r[2] == r[2]), key=lambda r: (r[2], r[1])):
        if u in last:
            out.append((u, e, t - last[u]))
        last[u] = t
    return sorted(out, key=repr)


def streamed(spark, folder, files, delay):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    points = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    found = run_closed(points, lambda p: intervals_in_order(p, "unit", "event_id", delay))
    return sorted(((r["unit"], r["event_id"], r["isi"]) for r in found.collect()), key=repr)


def test_shuffled_files_give_the_rows_of_the_table(spark, tmp_path):
    rng = random.Random(5)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), k, rng.randrange(-400, 4000) / 8) for k in range(400)]
    rows += [(1, 1000, None), (2, 1001, float("nan")), (9, 1002, 3.0)]
    rng.shuffle(rows)
    before = spark.conf.get(STATE_STORE)
    assert streamed(spark, str(tmp_path / "in"), [rows[k::5] for k in range(5)], "1 hour") == by_loop(rows)
    assert spark.conf.get(STATE_STORE) == before


def test_rows_within_the_delay_are_in_order_and_later_ones_go(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted(((k % 3, k, k / 4) for k in range(600)), key=lambda r: r[2] + rng.random() * 20)
    late = (0, 9999, 1.5)  # far behind the watermark of the last file
    files = [rows[k : k + 150] for k in range(0, 600, 150)]
    files[-1] = [*files[-1], late]
    assert streamed(spark, str(tmp_path / "in"), files, "20 seconds") == by_loop(rows)


def test_an_empty_stream(spark, tmp_path):
    assert streamed(spark, str(tmp_path / "in"), [[]], "1 second") == []


def test_units_of_a_bucket_are_kept_apart(spark, tmp_path, monkeypatch):
    from spikeframe.streaming import in_order

    monkeypatch.setattr(in_order, "CHUNK", 7)
    rng = random.Random(8)
    rows = [(rng.choice([*range(20), None]), k, rng.randrange(4000) / 8) for k in range(300)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    points = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = run_closed(points, lambda p: intervals_in_order(p, "unit", "event_id", "1 hour", buckets=3))
    assert sorted(((r["unit"], r["event_id"], r["isi"]) for r in found.collect()), key=repr) == by_loop(rows)
