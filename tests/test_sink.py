"""Files written by ranges have the bytes of files written whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeframe.session import SessionBuilder
from spikeframe.sources.codec import WriteOptions
from spikeframe.sources.datasource import read_session
from spikeframe.sources.sink import byte_ranges, write_files
from spikeframe.sources.writers import encode_files

from .test_sessions import full


@pytest.mark.parametrize("layout", ["wide", "narrow"])
def test_bytes_are_those_of_one_task(spark, tmp_path, layout):
    o = WriteOptions(layout=layout)
    x = np.sin(np.arange(5000) / 7)
    s = (full(spark).continuous("long", 1000, 7.0, x.tolist()).event("many", [k / 100 for k in range(1000)])
         .waveform("waves", 10_000, [k / 10 for k in range(40)], [[k, -k, 2 * k] for k in range(40)])
         .marker("words", [k / 10 for k in range(50)], {"a": ["x" * (k % 9) for k in range(50)], "b": [f"é{k}" for k in range(50)]}).build())
    whole = {r["session_id"]: bytes(r["content"]) for r in encode_files(s, o).collect()}
    write_files(s, str(tmp_path / "out"), ".bin", o, rows=16, samples=64)
    (path,) = (tmp_path / "out").iterdir()
    assert path.read_bytes() == next(iter(whole.values()))
    assert byte_ranges(s, o, rows=16, samples=64).count() > 100


def test_ranges_neither_overlap_nor_leave_gaps(spark):
    ranges = byte_ranges(full(spark).build(), rows=1, samples=2).select("at", F.length("raw").alias("n")).orderBy("at", "n").collect()
    at = 0
    for r in ranges:
        assert r["at"] == at
        at += r["n"]
    assert ranges[-1]["n"] == 0


def test_several_sessions_missing_rows_and_files_that_stand(spark, tmp_path):
    for k in range(3):
        write_files(SessionBuilder(spark, 1000, f"s{k}").event("e", [k + 0.5]).event("none", []).build(), str(tmp_path / f"d{k}"), ".bin")
    (tmp_path / "all").mkdir()
    for k in range(3):
        next((tmp_path / f"d{k}").iterdir()).rename(tmp_path / "all" / f"s{k}.bin")
    s = read_session(spark, str(tmp_path / "all" / "*.bin"))
    write_files(s, str(tmp_path / "copy"), ".bin")
    for k in range(3):
        assert (tmp_path / "copy" / f"s{k}.bin").read_bytes() == (tmp_path / "all" / f"s{k}.bin").read_bytes()
    with pytest.raises(Exception, match="FileExists|exists"):
        write_files(s, str(tmp_path / "copy"), ".bin", overwrite=False)
    assert len(list((tmp_path / "copy").iterdir())) == 3
    from dataclasses import replace
    with pytest.raises(Exception, match="IncompleteRead|rows"):
        write_files(replace(s, points=s.points.where("t > 1")), str(tmp_path / "short"), ".bin")
    assert list(tmp_path.glob("short/*")) == []


def test_no_part_is_a_whole_long_variable(spark, tmp_path):
    from spikeframe.plans import catalogue
    from spikeframe.sources.datasource import Wanted, open_reader, ranges, read_options

    n = 70_000
    times = spark.range(n).select(F.lit("many").alias("var_name"), F.col("id").alias("idx"), (F.col("id") / 100).alias("t"))
    one = lambda kind, **more: spark.range(1).select(F.lit("many").alias("var_name"), F.lit(n).alias("count"), F.lit(kind).alias("kind"), *(F.lit(x).alias(c) for c, x in more.items()))
    s = catalogue.session(spark, 1000.0, variables=one("event"), points=times.withColumn("kind", F.lit("event")))
    assert byte_ranges(s).agg(F.max(F.length("raw")).alias("n")).first()["n"] < n * 4
    cells = times.select("*", F.lit(0).alias("field_index"), F.lit("f").alias("field_name"), F.concat(F.lit("c"), "idx").alias("str"))
    marked = catalogue.session(spark, 1000.0, variables=one("marker", n_markers=1), markers=cells.withColumn("num", F.lit(None).cast("long")))
    write_files(marked, str(tmp_path / "m"), ".bin")
    (path,) = (tmp_path / "m").iterdir()
    found = ranges(open_reader(str(path), read_options({})), "markers", Wanted())
    assert [lo for _, lo, _, _ in found] == [0, 32768, 65536]
