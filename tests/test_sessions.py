import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeframe import cli
from spikeframe.errors import DuplicateVariable, IncompleteRead, InvalidFrequency, InvalidHeader, InvalidValues, TickOverflow, VariableNotFound, WrongKind
from spikeframe.operators.analysis import analyse
from spikeframe.session import Session, SessionBuilder, diff, maximum_timestamps
from spikeframe.sources.codec import Reader, ReadOptions, WriteOptions, encode_session
from spikeframe.sources.datasource import decode_files, read_session
from spikeframe.sources.detected import channel_neurons
from spikeframe.sources.phy import load_npy, read_phy, write_phy
from spikeframe.sources.writers import encode_files, export_spikes, format_seconds, write_session, write_sessions


def full(spark) -> SessionBuilder:
    return (
        SessionBuilder(spark, 10_000, "all kinds")
        .event("stim", [0.001, 0.002, 0.003]).neuron("unit a", [0.010, 0.020], wire=15, unit=2, x=25.5, y=35.0)
        .interval("trial", [(0, 1), (2, 3)]).marker("code", [0, 1], {"id": [1, 2]}).marker("note", [0.5, 1.5], {"label": ["abc", "xyz"]})
        .population("pop", [1.0, 2.5, 3.5]).waveform("spk", 10_000, [0.1, 0.2], [[2, 3, 4, 1], [5, 6, 7, 2]])
        .continuous("lfp", 1000, 0.05, [1.0, 2.0, 3.5]).continuous_i16("raw", 1000, 0.03, [5, 3, 4], 0.015, 0.2)
        .continuous_timed("gaps", 1000, [0.003, 0.004, 0.005, 0.1, 0.101], [1, 2, 3.5, 9, 5])
    )


@pytest.mark.parametrize("layout", ["wide", "narrow"])
def test_round_trip_of_all_kinds(spark, tmp_path, layout):
    path = str(tmp_path / "a.bin")
    s = full(spark).build()
    write_session(s, path, WriteOptions(layout=layout))
    back = read_session(spark, path)
    assert back.names() == s.names()
    assert back.sessions.first()["format"] == layout and back.sessions.first()["comment"] == "all kinds"
    for name, kind in (("stim", "event"), ("unit a", "neuron")):
        assert [r["t"] for r in back.payload(name, kind).orderBy("idx").collect()] == [r["t"] for r in s.payload(name, kind).orderBy("idx").collect()]
    assert [(r["t_start"], r["t_end"]) for r in back.payload("trial", "interval").orderBy("idx").collect()] == [(0, 1), (2, 3)]
    assert [r["num"] for r in back.payload("code", "marker").orderBy("idx").collect()] == [1, 2]
    assert [r["str"] for r in back.payload("note", "marker").orderBy("idx").collect()] == ["abc", "xyz"]
    assert [r["weight"] for r in back.payload("pop", "population").orderBy("idx").collect()] == [1.0, 2.5, 3.5]
    waves = [r["samples"] for r in back.payload("spk", "waveform").orderBy("idx").collect()]
    assert np.allclose(waves, [[2, 3, 4, 1], [5, 6, 7, 2]], atol=2e-4)
    frags = back.payload("gaps", "continuous").orderBy("fragment").collect()
    assert [len(r["values"]) for r in frags] == [3, 2] and [r["t0"] for r in frags] == [0.003, 0.1]
    assert np.allclose(back.payload("lfp", "continuous").first()["values"], [1.0, 2.0, 3.5], atol=2e-4)
    assert back.payload("raw", "continuous").first()["values"] == pytest.approx([5 * 0.015 + 0.2, 3 * 0.015 + 0.2, 4 * 0.015 + 0.2])
    unit = back.variables.where("var_name = 'unit a'").first()
    assert (unit["wire"], unit["unit"], unit["x_pos"], unit["y_pos"]) == (15, 2, 25.5, 35.0)
    again = str(tmp_path / "b.bin")
    write_session(back, again, WriteOptions(layout=layout))
    assert open(path, "rb").read() == open(again, "rb").read()


def test_header_bytes(spark):
    raw = bytes(encode_files(SessionBuilder(spark, 100_000, "minimal").event("stim", [0.001, 0.002]).build()).first()["content"])
    assert struct.unpack_from("<ii", raw) == (894977358, 501) and raw[8:15] == b"minimal" and struct.unpack_from("<d", raw, 264) == (100_000.0,)
    assert struct.unpack_from("<i", raw, 280) == (1,) and struct.unpack_from("<q", raw, 292) == (200,)
    offset, count = struct.unpack_from("<qq", raw, 356 + 72)
    assert (offset, count) == (356 + 244, 2) and struct.unpack_from("<ii", raw, offset) == (100, 200)
    meta, = struct.unpack_from("<Q", raw, 284)
    assert json.loads(raw[meta:])["variables"] == [{"name": "stim"}] and meta == offset + 8


def test_long_ticks_and_limits(spark):
    late = (2147483647 + 1000) / 100_000
    s = {"timestamp_frequency_hz": 100_000.0, "comment": ""}
    v = [{"var_name": "late", "kind": "event"}]
    raw = encode_session(s, v, {"late": {"t": np.array([late])}})
    r = Reader.of_bytes(raw)
    assert r.header.version == 502 and r.payload(r.header.variables[0])["t"][0] == pytest.approx(late, abs=1e-3)
    with pytest.raises(TickOverflow):
        encode_session(s, v, {"late": {"t": np.array([late])}}, WriteOptions(layout="narrow"))
    edge = encode_session(s, v, {"late": {"t": np.array([2**31 / 100_000])}})
    assert Reader.of_bytes(edge).header.version == 502
    with pytest.raises(IncompleteRead):
        Reader.of_bytes(raw[:604]).payload(Reader.of_bytes(raw).header.variables[0])
    with pytest.raises(InvalidHeader):
        Reader.of_bytes(b"no session")
    small = Reader.of_bytes(raw, ReadOptions(compact_timestamps=True))
    assert small.payload(small.header.variables[0])["t"][0] == float(np.float32(late))


def test_reading_some_variables(spark, tmp_path):
    path = str(tmp_path / "a.bin")
    write_session(full(spark).build(), path)
    some = read_session(spark, path, names=["lfp", "unknown"])
    assert len(some.names()) == 10 and some.points.count() == 0 and {r["var_name"] for r in some.continuous.collect()} == {"lfp"}
    assert read_session(spark, path, names=[]).continuous.count() == 0
    files = spark.read.format("binaryFile").load(path)
    assert decode_files(files, "points").count() == 5 and decode_files(files, "variables").count() == 10


def test_many_files(spark, tmp_path):
    for k in range(3):
        write_session(SessionBuilder(spark, 1000, f"s{k}").event("e", [k + 0.5]).build(), str(tmp_path / f"s{k}.bin"))
    s = read_session(spark, str(tmp_path / "*.bin"))
    assert sorted(r["t"] for r in s.points.collect()) == [0.5, 1.5, 2.5] and s.sessions.count() == 3
    out = write_sessions(s, str(tmp_path / "copy"), ".bin").collect()
    assert len(out) == 3 and read_session(spark, str(tmp_path / "copy" / "*.bin")).points.count() == 3


def test_algebra(spark):
    a = SessionBuilder(spark, 1000).event("a", [1.0]).neuron("n", [5.0]).build()
    b = SessionBuilder(spark, 1000, "other").event("b", [2.0]).build()
    both = a.merge(b)
    assert both.names() == ["a", "n", "b"] and both.sessions.first()["comment"] == "other" and both.sessions.first()["end_seconds"] == 5.0
    assert both.rename("a", "alpha").names() == ["alpha", "n", "b"]
    cut = both.subset(["b", "a"])
    assert cut.names() == ["b", "a"] and cut.sessions.first()["end_seconds"] == 2.0
    assert both.delete("n").names() == ["a", "b"] and both.delete("n").sessions.first()["end_seconds"] == 5.0
    assert diff(both, both).count() == 0
    assert {(r["var_name"], r["status"]) for r in diff(a, cut).collect()} == {("n", "only_in_a"), ("b", "only_in_b")}
    for f, e in ((lambda: a.merge(a), DuplicateVariable), (lambda: a.subset(["a", "a"]), DuplicateVariable), (lambda: a.subset(["x"]), VariableNotFound), (lambda: a.rename("a", "n"), DuplicateVariable),
                 (lambda: a.payload("a", "neuron"), WrongKind), (lambda: a.merge(SessionBuilder(spark, 999).build()), InvalidFrequency)):
        with pytest.raises(e):
            f()


def test_builder_checks(spark):
    b = SessionBuilder(spark, 10_000)
    for f in (lambda: b.interval("bad", [(1.0, 0.5)]), lambda: b.event("", []), lambda: b.waveform("w", 0, [], []), lambda: b.waveform("w", 1, [0], [[1], [2]]), lambda: b.marker("m", [0], {"f": []}),
              lambda: b.continuous("c", 0, 0, [1.0]), lambda: b.continuous_timed("c", 3333, [0], [1])):
        with pytest.raises(InvalidValues):
            f()
    with pytest.raises(InvalidFrequency):
        SessionBuilder(spark, 0)
    one = b.continuous_timed("one", 1000, [0.5], [1.0]).build()
    assert one.sessions.first()["end_seconds"] == 0.5


def test_ends_and_json(spark):
    s = full(spark).build()
    ends = {r["var_name"]: r["max_t"] for r in maximum_timestamps(s).collect()}
    assert ends["spk"] == pytest.approx(0.2 + 3 / 10_000) and ends["lfp"] == pytest.approx(0.052) and ends["trial"] == 3.0 and ends["pop"] == 0.0
    back = Session.from_json(spark, s.to_json())
    assert back.names() == s.names() and diff(s, back).count() == 0
    assert s.metadata().where("var_name = 'unit a'").first()["wire"] == 15
    info = s.info().first()
    assert (info["n_neuron"], info["n_event"], info["n_continuous"], info["n_interval"]) == (1, 1, 3, 1)


def test_export_and_analysis(spark, tmp_path, capsys):
    s = SessionBuilder(spark, 100_000).event("ev", [0.10, 0.30]).neuron("u", [0.10, 0.15, 0.25, 0.35]).event("big", [1.0, 1e-7 * 100, 12345.5]).build()
    assert [r["value"] for r in export_spikes(s, "ev").collect()] == ["timestamp_sec", "0.1", "0.3"]
    assert export_spikes(s, "ev", comment=True).first()["value"] == "# timestamp_sec"
    assert [format_seconds(x) for x in (1.0, 1e-5, 12345.5)] == ["1", "0.00001", "12345.5"]
    found = analyse(s, "u", "ev", 0.0, 0.1, 0.05)
    assert [r["count"] for r in found.psth.orderBy("bin").collect()] == [3, 0] and found.raster.count() == 2
    path = str(tmp_path / "a.bin")
    write_session(s, path)
    assert cli.main(["info", path], spark) == 0 and cli.main(["psth", path, "u", "ev", "--start", "0", "--end", "0.1", "--bin-width", "0.05"], spark) == 0
    assert cli.main(["export-spikes", path, "ev", "--output", str(tmp_path / "ev.txt")], spark) == 0
    said = capsys.readouterr().out
    assert "neurons: 1" in said and "total: 3" in said and open(tmp_path / "ev.txt").read() == "timestamp_sec\n0.1\n0.3\n"


def test_phy(spark, tmp_path):
    folder = tmp_path / "phy"
    folder.mkdir()
    np.save(folder / "spike_times.npy", np.array([100, 200, 150], "<i8"))
    np.save(folder / "spike_clusters.npy", np.array([1, 1, 2], "<i4"))
    rows = {(r["var_name"], r["idx"]): r["t"] for r in read_phy(spark, str(folder), 10_000).collect()}
    assert rows == {("unit_1", 0): 0.01, ("unit_1", 1): 0.02, ("unit_2", 0): 0.015}
    write_phy(spark.createDataFrame([(100, 0), (200, 1)], "sample long, unit long"), str(tmp_path / "out"))
    assert [r["var_name"] for r in read_phy(spark, str(tmp_path / "out")).collect()] == ["unit_1"]
    assert read_phy(spark, str(tmp_path / "out"), skip_noise=False).count() == 2
    assert cli.main(["import-phy", str(folder), str(tmp_path / "p.bin"), "--rate", "10000"], spark) == 0
    assert read_session(spark, str(tmp_path / "p.bin")).names("neuron") == ["unit_1", "unit_2"]
    np.save(folder / "spike_clusters.npy", np.array([1, 1], "<i4"))
    with pytest.raises(InvalidValues):
        read_phy(spark, str(folder)).count()
    with pytest.raises(InvalidValues):
        load_npy((folder / "spike_times.npy").read_bytes(), ("<i4",))


def test_sort_command(spark, tmp_path):
    rate = 20_000
    x = np.random.default_rng(2).normal(0, 0.5, rate)
    for c in (0.2, 0.7):
        k = int(c * rate)
        x[k : k + 25] += 50 * np.exp(-((np.arange(25) - 12.0) ** 2) / 18)
    write_session(SessionBuilder(spark, rate).continuous("raw", rate, 0.0, x.tolist()).build(), str(tmp_path / "r.bin"))
    assert cli.main(["sort", str(tmp_path / "r.bin"), "raw", str(tmp_path / "s.bin"), "--phy", str(tmp_path / "phy"), "--threshold", "12"], spark) == 0
    assert read_session(spark, str(tmp_path / "s.bin")).points.count() >= 2


def test_detected_channels(spark):
    rows = channel_neurons(spark.createDataFrame([(3, 20.0), (3, 10.0), (4, 5.0)], "channel int, time_ms double")).orderBy("var_name", "idx").collect()
    assert [(r["var_name"], r["t"]) for r in rows] == [("ch_3", 0.01), ("ch_3", 0.02), ("ch_4", 0.005)]


def test_columns(spark):
    from spikeframe.functions import marker_number, quantise_i16, round_half_away, sanitize_name, seconds_to_ticks

    row = spark.range(1).select(
        *(round_half_away(F.lit(x)).alias(f"r{i}") for i, x in enumerate((0.5, -0.5, 1.5, 2.5, -2.5, 0.49999))),
        quantise_i16(F.lit(1e9), 0.5).alias("big"), quantise_i16(F.lit(float("nan")), 0.5).alias("nan"), seconds_to_ticks(F.lit(0.001), 100_000.0).alias("tick"),
        sanitize_name(F.lit(" a/b ")).alias("name"), sanitize_name(F.lit("  ")).alias("none"), marker_number(F.lit("+007")).alias("m"), marker_number(F.lit("4294967296")).alias("m2"), marker_number(F.lit("x")).alias("m3")).first()
    assert [row[f"r{i}"] for i in range(6)] == [1.0, -1.0, 2.0, 3.0, -3.0, 0.0]
    assert (row["big"], row["nan"], row["tick"], row["name"], row["none"], row["m"], row["m2"], row["m3"]) == (32767, 0, 100, "a_b", "unnamed", 7, None, None)


def test_two_sessions_in_one(spark):
    a = SessionBuilder(spark, 1000, session_id="one").neuron("u", [1.0, 2.0], wire=3).event("e", [0.5]).build()
    b = SessionBuilder(spark, 1000, session_id="two").neuron("u", [5.0, 6.0, 7.0], wire=4).event("e", [0.25, 9.0]).build()
    both = a.union(b)
    assert {(r["session_id"], r["var_name"], r["count"], r["max_t"]) for r in maximum_timestamps(both).collect()} == {("one", "u", 2, 2.0), ("one", "e", 1, 0.5), ("two", "u", 3, 7.0), ("two", "e", 2, 9.0)}
    assert both.names() == ["u", "e"]
    assert {(r["session_id"], r["end_seconds"]) for r in both.subset(["u"]).sessions.collect()} == {("one", 2.0), ("two", 7.0)}
    assert {(r["session_id"], r["wire"]) for r in both.metadata().where("var_name = 'u'").collect()} == {("one", 3), ("two", 4)}
    assert {(r["session_id"], r["n_neuron"], r["n_event"]) for r in both.info().collect()} == {("one", 1, 1), ("two", 1, 1)}
    assert both.timestamps("u").count() == 5 and both.timestamp_range("u", 0, 2).count() == 4
    assert {(r["session_id"], r["var_name"], r["status"]) for r in diff(both, both.delete("e")).collect()} == {("one", "e", "only_in_a"), ("two", "e", "only_in_a")}
    assert len(encode_files(both).collect()) == 2
    for f, e in ((lambda: both.merge(a), InvalidValues), (lambda: both.union(a), DuplicateVariable), (lambda: both.timestamp_range("u", 1, 2), IncompleteRead), (lambda: a.union(SessionBuilder(spark, 1, session_id="x").build()).payload("u", "neuron"), VariableNotFound)):
        with pytest.raises(e):
            f()


def test_markers_cell_by_cell(spark, tmp_path):
    path = str(tmp_path / "m.bin")
    write_session(SessionBuilder(spark, 1000).marker("m", [0, 1, 2], {"n": ["7", "+12", "4294967295"], "s": ["a", "4294967296", "8"]}).build(), path)
    rows = read_session(spark, path).payload("m", "marker").orderBy("field_index", "idx").collect()
    assert [(r["num"], r["str"]) for r in rows] == [(7, None), (12, None), (4294967295, None), (None, "a"), (None, "4294967296"), (8, None)]
    kept = read_session(spark, path, numeric_strings=False).payload("m", "marker").orderBy("field_index", "idx").collect()
    assert [r["str"] for r in kept] == ["7", "+12", "4294967295", "a", "4294967296", "8"]


def test_parts_of_variables(spark, tmp_path, monkeypatch):
    from spikeframe.sources import datasource

    path = str(tmp_path / "p.bin")
    times = [k / 1000 for k in range(500)]
    s = SessionBuilder(spark, 1000).event("e", times).neuron("u", times).continuous("lfp", 1000, 0.5, [float(k) for k in range(700)]).waveform("w", 1000, times, [[k, k + 1] for k in range(500)], cont_data_type=1)
    write_session(s.marker("m", times, {"k": list(range(500))}).interval("i", [(t, t + 1) for t in times]).population("p", times).build(), path)
    monkeypatch.setattr(datasource, "UNIT_BYTES", 256)
    raw = open(path, "rb").read()
    for table, n in (("points", 1000), ("waveforms", 500), ("markers", 500), ("intervals", 500), ("population", 500)):
        parts = [b for k in range(5) for b in datasource.table_batches(Reader.of_bytes(raw), path, table, None, k, 5)]
        whole = list(datasource.table_batches(Reader.of_bytes(raw), path, table))
        assert sum(b.num_rows for b in parts) == n and sorted(map(str, (r for b in parts for r in b.to_pylist()))) == sorted(map(str, (r for b in whole for r in b.to_pylist())))
    parts = sorted((r["first_sample"], r["t0"], r["values"]) for k in range(3) for b in datasource.table_batches(Reader.of_bytes(raw), path, "continuous", None, k, 3) for r in b.to_pylist())
    assert [v for *_, values in parts for v in values] == pytest.approx([float(k) for k in range(700)], abs=0.02) and all(t == pytest.approx(0.5 + a / 1000) for a, t, _ in parts)
    back = read_session(spark, path)
    assert [r["t"] for r in back.timestamp_range("e", 100, 3).orderBy("idx").collect()] == [0.1, 0.101, 0.102]
    with pytest.raises(IncompleteRead):
        back.timestamp_range("e", 499, 2)
    # two variables of one file in one query
    a, b = back.payload("e", "event"), back.payload("u", "neuron").select(F.col("t").alias("u"))
    assert a.join(b, a.t == b.u).count() == 500
    some = read_session(spark, path, names=["e"])
    assert some.is_loaded("e") and not some.is_loaded("u") and some.event("e").count() == 500
    with pytest.raises(IncompleteRead):
        some.neuron("u")


def test_files_of_one_name(spark, tmp_path):
    for k in "ab":
        (tmp_path / k).mkdir()
        write_session(SessionBuilder(spark, 1000, k).event("e", [1.0]).build(), str(tmp_path / k / "same.bin"))
    s = read_session(spark, str(tmp_path / "*" / "same.bin"))
    out = write_sessions(s, str(tmp_path / "copy"), ".bin").collect()
    assert len({r["path"] for r in out}) == 2 and read_session(spark, str(tmp_path / "copy" / "*.bin")).sessions.count() == 2


def test_writing_needs_whole_variables(spark):
    """Signals and markers whose tables lack rows that the header counts are not written."""
    from dataclasses import replace

    s = full(spark).build()
    for short in (replace(s, continuous=s.continuous.where("NOT (var_name = 'gaps' AND fragment = 1)")), replace(s, markers=s.markers.where("NOT (var_name = 'note' AND idx = 1)"))):
        with pytest.raises(Exception, match="load the whole variable"):
            encode_files(short).collect()


def test_a_variable_without_rows_is_loaded(spark):
    from dataclasses import replace

    s = replace(SessionBuilder(spark, 1000, "").event("none", []).event("some", [1.0]).build(), loaded=frozenset())
    assert s.is_loaded("none") and not s.is_loaded("some") and s.event("none").count() == 0
    with pytest.raises(IncompleteRead):
        s.event("some")


def test_channels_of_two_rates(spark):
    from spikeframe.operators.sorting import SortOptions, sort_channels

    rows = spark.createDataFrame([("s", 0, 0, 1.0, 1000.0), ("s", 1, 0, 1.0, 2000.0)], "session_id string, channel int, pos long, value double, sampling_rate double")
    with pytest.raises(InvalidValues, match="rate"):
        sort_channels(rows, SortOptions(sampling_rate=1000.0))
