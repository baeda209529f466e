import math
import random

import pytest
from pyspark.sql import functions as F

from spikeframe.operators import signals, sorting, spikes


def points(spark, times, unit="u"):
    return spark.createDataFrame([(unit, i, float(t)) for i, t in enumerate(times)], "unit string, idx long, t double")


def column(df, name, order="bin"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_filter_and_sort(spark):
    assert column(spikes.in_range(points(spark, [0.01, 0.05, 0.10, 0.20]), 0.04, 0.15), "t", "t") == [0.05, 0.10]
    assert column(spikes.in_range(points(spark, [0.04, 0.15]), 0.04, 0.15), "t", "t") == [0.04, 0.15]
    assert [r["t"] for r in spikes.sorted_points(points(spark, [0.2, 0.1, 0.3])).collect()] == [0.1, 0.2, 0.3]


def test_isi_histogram(spark):
    train = points(spark, [0, 0.01, 0.03, 0.06])
    assert column(spikes.intervals_between(train), "isi", "t") == pytest.approx([0.01, 0.02, 0.03])
    assert column(spikes.isi_histogram(train, 0.01), "count") == [0, 2, 0, 1]
    assert spikes.isi_histogram(points(spark, [1.0]), 0.01).count() == 0
    with pytest.raises(ValueError):
        spikes.isi_histogram(train, 0)


def test_psth(spark):
    s, e = points(spark, [0.10, 0.15, 0.25, 0.35]), points(spark, [0.10, 0.30])
    found = spikes.psth(s, e, 0.0, 0.10, 0.05)
    assert column(found, "count") == [3, 0]
    assert column(found, "rate_hz") == pytest.approx([30.0, 0.0])
    assert column(found, "n_events") == [2, 2]
    default = spikes.psth(points(spark, [0.01, 0.02]), points(spark, [0.0]))
    assert default.count() == 150 and sum(column(default, "count")) == 2
    none = spikes.psth(s, points(spark, []), 0.0, 0.1, 0.05)
    assert column(none, "count") == [0, 0] and column(none, "rate_hz") == [0.0, 0.0]
    for bad in ((0.0, 0.0, 0.1), (0.0, 1.0, 0.0)):
        with pytest.raises(ValueError):
            spikes.psth(s, e, *bad)


def test_raster_keeps_empty_trials(spark):
    s, e = points(spark, [0.10, 0.15, 0.25]), points(spark, [0.10, 0.30, 99.0])
    assert column(spikes.raster(s, e), "trial", "idx") == [[0.0, 0.04999999999999999, 0.15], [-0.19999999999999998, -0.15, -0.04999999999999999], []]


def test_cross_correlogram(spark):
    s = points(spark, [0.10, 0.15, 0.25])
    got = column(spikes.cross_correlogram(s, s, 0.1, 0.01), "count")
    want = [0] * 20
    for a in (0.10, 0.15, 0.25):
        for b in (0.10, 0.15, 0.25):
            k = math.floor((a - b + 0.1) / 0.01)
            if abs(a - b) <= 0.1 and k < 20:
                want[k] += 1
    assert got == want and sum(want) > 3


def test_smoothing(spark):
    bins = spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "bin long, count long")
    assert column(spikes.smooth_rate(bins, 0.01, 1.0), "rate") == pytest.approx([93.7128, 128.2173, 93.7128], abs=1e-4)
    assert column(spikes.smooth_rate(bins, 0.01, 0.0), "rate") == [100.0, 200.0, 100.0]
    assert spikes.smooth_rate(bins, 0.0, 1.0).count() == 0


def test_units_by_rate(spark):
    variables = spark.createDataFrame([("slow", 0, "neuron"), ("fast", 1, "neuron"), ("mute", 2, "neuron"), ("tied", 3, "neuron"), ("ev", 4, "event")], "var_name string, var_index int, kind string")
    pts = spark.createDataFrame([("slow",)] * 2 + [("fast",)] * 4 + [("tied",)] * 2 + [("ev",)] * 9, "var_name string")
    found = spikes.units_by_rate(variables, pts, 0.0, 1.0)
    assert column(found, "var_name", "rank") == ["fast", "slow", "tied", "mute"]


def test_random_trains_agree_with_loops(spark):
    rng = random.Random(3)
    s, e = [rng.randrange(2000) / 100 for _ in range(200)], [rng.randrange(2000) / 100 for _ in range(40)]
    for start, end, width in ((-0.5, 1.0, 0.1), (0.25, 3.0, 0.5), (-2.0, -1.0, 0.3)):
        n = max(1, math.ceil((end - start) / width))
        want = [0] * n
        pairs = 0
        for b in e:
            for a in s:
                if b + start <= a <= b + end:
                    pairs += 1
                    k = math.floor((a - b - start) / width)
                    if start <= a - b < end and k < n:
                        want[k] += 1
        assert column(spikes.psth(points(spark, s), points(spark, e), start, end, width), "count") == want
        assert sum(map(len, column(spikes.raster(points(spark, s), points(spark, e), start, end), "trial", "idx"))) == pairs


def test_fragments_and_refractory(spark):
    ticks = spark.createDataFrame([("u", t) for t in (30, 40, 50, 1000, 1010)], "unit string, tick long")
    found = signals.fragments(ticks, 10).orderBy("fragment").collect()
    assert [(r["first_tick"], r["first_index"], r["count"]) for r in found] == [(30, 0, 3), (1000, 3, 2)]
    peaks = spark.createDataFrame([("u", p) for p in (1, 3, 6, 7, 11, 30)], "unit string, sample long")
    assert column(signals.suppress_refractory(peaks, 5), "sample", "sample") == [1, 6, 11, 30]
    assert column(signals.suppress_refractory(peaks, 5, most=2), "sample", "sample") == [1, 6]


def test_sorting_agrees_with_dataframe_steps(spark):
    rng = random.Random(5)
    x = [rng.gauss(0, 1) for _ in range(400)]
    df = spark.createDataFrame([("u", float(i), v) for i, v in enumerate(x)], "unit string, t double, value double")
    sigma = signals.robust_sigma(df, ["unit"]).first()["sigma"]
    import numpy as np

    assert sigma == sorting.robust_std(np.array(x))
    peaks = signals.suppress_refractory(signals.local_peaks(df, 1.5), 4)
    assert column(peaks, "sample", "sample") == sorting.detect_peaks(np.array(x), 1.5, 4, 10**9).tolist()


def model_filter(x, rate, low, high):
    import numpy as np

    f32 = lambda v: float(np.float32(v))
    x = [f32(v) for v in x]
    dt, rc = 1 / rate, 1 / (2 * math.pi * max(low, 1.0))
    a, y = rc / (rc + dt), [x[0]]
    for i in range(1, len(x)):
        y.append(f32(a * (y[-1] + x[i] - x[i - 1])))
    rc = 1 / (2 * math.pi * max(high, 1.0))
    a, z = dt / (rc + dt), [y[0]]
    for v in y[1:]:
        z.append(f32(z[-1] + a * (v - z[-1])))
    return z


def test_bandpass_is_the_plain_loop(spark):
    rng = random.Random(7)
    x = {u: [rng.gauss(0, 10) for _ in range(50)] for u in ("a", "b")}
    df = spark.createDataFrame([(u, float(i), v) for u in x for i, v in enumerate(x[u])], "unit string, t double, value double").repartition(3)
    found = sorting.bandpass(df, 1000.0, 10.0, 300.0, ["unit"], ["t"])
    for u in x:
        assert column(found.where(F.col("unit") == u), "filtered", "sample") == model_filter(x[u], 1000.0, 10.0, 300.0)


@pytest.mark.parametrize("rate, centres, width", [(30_000, (0.05, 0.15, 0.25, 0.35), 20), (20_000, (0.2, 0.8), 18)])
def test_sorting_finds_bumps(spark, rate, centres, width):
    import numpy as np

    trace = np.random.default_rng(1).normal(0, 0.5, 2 * rate)
    for c in centres:
        k = int(c * rate)
        i = np.arange(30)
        trace[k : k + 30] += 50 * np.exp(-((i - 15.0) ** 2) / width)
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(trace)], "session_id string, pos long, value double").withColumn("channel", F.lit(0))
    found = sorting.sort_channels(df, sorting.SortOptions(sampling_rate=float(rate), threshold=12.0)).collect()
    assert len(found) >= len(centres)
    for c in centres:
        assert any(abs(r["t"] - c - 15 / rate) < 0.002 for r in found)
    assert sorting.sort_trace(np.zeros(10), sorting.SortOptions())[0].size == 0


def test_refractory_fold_over_long_trains(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    at = np.unique(rng.integers(0, 60_000, 20_000)).tolist() + list(range(100_000, 100_500))
    kept = []
    for i in at:
        if not kept or i >= kept[-1] + 7:
            kept.append(i)
    df = spark.createDataFrame([("u", i) for i in at] + [("v", 3)], "unit string, sample long")
    got = signals.suppress_refractory(df, 7)
    assert sorted(r["sample"] for r in got.where("unit = 'u'").collect()) == kept and got.where("unit = 'v'").count() == 1
    assert sorted(r["sample"] for r in signals.suppress_refractory(df.where("unit = 'u'"), 7, most=5).collect()) == kept[:5]


def test_channels_must_have_one_length(spark):
    import pytest

    from spikeframe.errors import InvalidValues
    from spikeframe.operators.sorting import SortOptions, sort_channels

    rows = [("s", c, i, float(i % 5)) for c in range(2) for i in range(100 + c)]
    with pytest.raises(InvalidValues):
        sort_channels(spark.createDataFrame(rows, "session_id string, channel int, pos long, value double"), SortOptions())


def test_bins_are_counted_without_pairs(spark, monkeypatch):
    """Ties, bursts and edges, against all pairs; with small limits, so that bursts are dealt out and slices are many."""
    import numpy as np

    from spikeframe.operators import range_join

    rng = random.Random(8)
    s = [round(rng.uniform(0, 30), rng.choice([1, 2, 6])) for _ in range(900)] + [7.3] * 200 + [7.0 + i / 1000 for i in range(800)]
    e = [round(rng.uniform(0, 30), 1) for _ in range(90)] + [7.3] * 5 + [7.2 + i / 500 for i in range(100)]
    a, b = (spark.createDataFrame([(x,) for x in v], "t double").repartition(3) for v in (s, e))
    rel = np.array(s)[:, None] - np.array(e)[None, :]

    def want(start, end, n, width, closed):
        at = np.floor((rel - start) / width)
        ok = (rel >= start) & ((rel <= end) if closed else (rel < end)) & (at < n)
        if not closed:  # a window is also tested from the event's side
            ok &= (np.array(s)[:, None] >= np.array(e)[None, :] + start) & (np.array(s)[:, None] <= np.array(e)[None, :] + end)
        return np.bincount(at[ok].astype(int), minlength=n).tolist()

    for dense, at_once in ((50_000, 1 << 20), (60, 500)):
        monkeypatch.setattr(range_join, "DENSE", dense)
        monkeypatch.setattr(range_join, "AT_ONCE", at_once)
        for start, end, width in ((-0.5, 1.0, 0.01), (-2.0, 2.0, 0.1), (0.1, 0.7, 0.25)):
            n = math.ceil((end - start) / width)
            got = spikes.psth(a, b, start, end, width)
            assert column(got, "count") == want(start, end, n, width, False)
        assert column(spikes.cross_correlogram(a, b, 1.0, 0.1), "count") == want(-1.0, 1.0, 20, 0.1, True)
    monkeypatch.undo()
    plan = spikes.cross_correlogram(a, b, 1.0, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[1]


def test_a_burst_is_dealt_out(spark, monkeypatch):
    """A third of all spikes in one window: no share of a bucket has many more rows than the limit, and no pair is lost."""
    from spikeframe.operators import range_join
    from spikeframe.operators.range_join import bucketed, dealt_out, window_join

    rng = random.Random(3)
    s = [rng.uniform(0, 100) for _ in range(2000)] + [50 + rng.random() / 2 for _ in range(1000)]
    e = [float(i) for i in range(100)] + [50 + i / 100 for i in range(60)]
    a = spark.createDataFrame([(i, x) for i, x in enumerate(s)], "i int, s double").repartition(3)
    b = spark.createDataFrame([(k, x) for k, x in enumerate(e)], "k int, e double").repartition(3)
    monkeypatch.setattr(range_join, "CROWDED", 80)
    want = sorted((i, k) for i, x in enumerate(s) for k, y in enumerate(e) if y + -0.5 <= x <= y + 0.5)
    assert sorted((r["i"], r["k"]) for r in window_join(a, b, "s", "e", -0.5, 0.5).collect()) == want
    left, right, salts = dealt_out(*bucketed(a, b, "s", "e", -0.5, 0.5), ["_bucket"], 80, ["i", "s"], ["k", "e"])
    assert salts and max(r["count"] for r in left.groupBy("_bucket", *salts).count().collect()) <= 120
