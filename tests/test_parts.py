"""Trains cut in parts: the same rows as whole trains and as plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeframe.operators import signals, spikes
from spikeframe.operators.parts import numbered


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_numbers_of_a_million_rows(spark, adaptive):
    n = 1_000_000
    rows = spark.range(n).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1_000_003).alias("x"))
    for by in ([], ["g"]):
        got = numbered(rows, by, ["x"], "i")
        if not by:
            assert tuple(got.agg(F.count("*"), F.countDistinct("i"), F.min("i"), F.max("i")).first()) == (n, n, 0, n - 1)
        else:
            per = {r["g"]: tuple(r)[1:] for r in got.groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("i").alias("k"), F.max("i").alias("m")).collect()}
            assert per == {g: (k, k, k - 1) for g, k in ((0, 333_334), (1, 333_333), (2, 333_333))}
    x = np.sort(np.arange(n) * 7919 % 1_000_003)
    some = numbered(rows, [], ["x"], "i").where("i % 100003 = 0").collect()
    assert all(x[r["i"]] == r["x"] for r in some) and len(some) == 10


def test_numbers_of_ties_and_null_groups(spark):
    data = [(None if i % 3 == 0 else "g", i % 5, i) for i in range(1000)]
    got = numbered(spark.createDataFrame(data, "g string, x int, id int").repartition(5), ["g"], ["x"], "i").collect()
    assert sorted(r["id"] for r in got) == list(range(1000))
    for g in (None, "g"):
        own = sorted((r["i"], r["x"]) for r in got if r["g"] == g)
        assert [i for i, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)


@pytest.mark.parametrize("most", [50_000, 1000, None])
def test_robust_sigma_of_a_million_rows(spark, adaptive, most):
    n = 300_000 if most == 1000 else 1_000_000
    rows = spark.range(n).select((F.col("id") % 3).alias("g"), F.col("id").alias("t"), ((F.col("id") * 7919 % 1_000_003) / 1000.0 - 400).alias("value"))
    got = {r["g"]: (r["median"], r["sigma"]) for r in signals.robust_sigma(rows, ["g"], most=most).collect()}
    i = np.arange(n)
    x = (i * 7919 % 1_000_003) / 1000.0 - 400
    for g in range(3):
        own = x[i % 3 == g]
        if most and len(own) > most:
            own = own[:: len(own) // most]
        median = np.sort(own)[len(own) // 2]
        assert got[g] == (median, max(np.sort(np.abs(own - median))[len(own) // 2], 1e-9) * 1.4826)


def test_order_statistics_of_odd_doubles(spark):
    values = [0.0, -0.0, math.inf, -math.inf, math.nan, 5e-324, -5e-324, 1e308, -1e308, 1.0, 1.0, 1.0000000000000002, -3.5]
    rows = spark.createDataFrame([(None, v) for v in values] + [("b", 2.0), ("b", None)], "g string, value double")
    want = sorted((v for v in values if v == v)) + [math.nan]
    for k in range(len(values)):
        got = {r["g"]: r["_found"] for r in signals.order_statistic(rows, F.least(F.lit(k), F.col("n") - 1), ["g"]).collect()}
        assert got["b"] == 2.0 and (got[None] == want[k] or math.isnan(want[k]) and math.isnan(got[None]))
    assert signals.order_statistic(rows.limit(0), F.lit(0), []).count() == 0


def train(seed, n):
    rng = random.Random(seed)
    t, out = 0, []
    for _ in range(n):
        t += rng.choice([1, 1, 1, 1, 2, 3, 9])
        out.append((t, float(rng.randint(-6, 6))))
    return out


@pytest.fixture(scope="module")
def samples(spark):
    data = [(g, t, x) for g, n in (("a", 500), ("b", 37), (None, 90), ("c", 1)) for t, x in train(n, n)]
    return spark.createDataFrame(data, "unit string, t long, value double").repartition(6).cache()


@pytest.mark.parametrize("part", [7, 30, 499, 500])
def test_windows_over_parts(samples, adaptive, part):
    assert rows_of(spikes.intervals_between(samples, part_rows=part), "unit", "t", "isi") == rows_of(spikes.intervals_between(samples), "unit", "t", "isi")
    kept = signals.fragments(samples, 1, tick="t", part_rows=part)
    names = ("unit", "fragment", "first_tick", "first_index", "count")
    assert rows_of(kept, *names) == rows_of(signals.fragments(samples, 1, tick="t"), *names)
    assert kept.columns == list(names)
    names = ("unit", "t", "value", "sample")
    peaks = signals.local_peaks(samples, 2.0, part_rows=part)
    assert rows_of(peaks, *names) == rows_of(signals.local_peaks(samples, 2.0), *names) and peaks.columns == ["unit", "t", "value", "sample"]


def test_windows_equal_loops(samples):
    got = {(r["unit"], r["fragment"]): (r["first_tick"], r["first_index"], r["count"]) for r in signals.fragments(samples, 1, tick="t", part_rows=11).collect()}
    want = {}
    for g, n in (("a", 500), ("b", 37), (None, 90), ("c", 1)):
        t = [x[0] for x in train(n, n)]
        starts = [i for i in range(n) if i == 0 or t[i] != t[i - 1] + 1]
        want |= {(g, k): (t[i], i, j - i) for k, (i, j) in enumerate(zip(starts, [*starts[1:], n]))}
    assert got == want


@pytest.mark.parametrize("part", [5, 64, 10_000])
@pytest.mark.parametrize("refractory", [0, 1, 4, 23])
def test_refractory_over_parts(spark, part, refractory):
    data, want = [], []
    for g, n in (("dense", 700), ("b", 60), (None, 9)):
        rng = random.Random(n)
        s, last = 0, None
        for _ in range(n):
            s += rng.choice([0, 1, 1, 2, 3]) if g == "dense" else rng.choice([1, 5, 30])
            data.append((g, s))
            if last is None or s >= last + refractory:
                want.append((g, s))
                last = s
    peaks = spark.createDataFrame(data, "unit string, sample int").repartition(4)
    assert rows_of(signals.suppress_refractory(peaks, refractory, part_rows=part), "unit", "sample") == sorted(want, key=repr)


def test_refractory_of_a_long_dense_train(spark):
    """A single run of 10^6 close peaks, in parts of 50,000."""
    peaks = spark.range(1_000_000).select((F.col("id") * 2 + F.col("id") % 3).alias("sample"))
    s = np.arange(1_000_000) * 2 + np.arange(1_000_000) % 3
    n = total = 0
    last = None
    for x in s.tolist():
        if last is None or x >= last + 11:
            n, total, last = n + 1, total + x, x
    got = signals.suppress_refractory(peaks, 11, [], part_rows=50_000).agg(F.count("*"), F.sum("sample")).first()
    assert tuple(got) == (n, total)


def test_smoothing_over_parts(spark):
    data = [(g, b, (b * b) % 11) for g, lo, hi in (("a", -7, 300), (None, 0, 40)) for b in range(lo, hi)]
    bins = spark.createDataFrame(data, "unit string, bin long, count long").repartition(3)
    names = ("unit", "bin", "count", "rate")
    assert rows_of(spikes.smooth_rate(bins, 0.5, 2.0, ["unit"], part_rows=10), *names) == rows_of(spikes.smooth_rate(bins, 0.5, 2.0, ["unit"]), *names)
    one = bins.where("unit = 'a'").drop("unit")
    assert rows_of(spikes.smooth_rate(one, 0.5, 2.0, part_rows=10), *names[1:]) == rows_of(spikes.smooth_rate(one, 0.5, 2.0), *names[1:])


@pytest.mark.parametrize(("part", "warm_up"), [(1000, 200), (1000, 1), (97, 97), (2000, 4096)])
def test_filters_over_parts_are_bit_equal(spark, part, warm_up):
    from spikeframe.operators import sorting

    data, want = [], {}
    for g, n in (("a", 5000), (None, 2311), ("c", 1)):
        rng = np.random.default_rng(n)
        x = (rng.normal(size=n) * 40 + 20 * np.sin(np.arange(n) / 9)).astype(np.float32)
        data += [(g, i, float(v)) for i, v in enumerate(x)]
        want |= {(g, i): float(v) for i, v in enumerate(sorting.filter_samples(x, 1000.0, 10.0, 300.0))}
    signal = spark.createDataFrame(data, "unit string, t int, value double").repartition(5)
    got = sorting.bandpass(signal, 1000.0, 10.0, 300.0, ["unit"], ["t"], part_rows=part, warm_up=warm_up)
    assert got.columns == ["unit", "sample", "filtered"]
    assert {(r["unit"], r["sample"]): r["filtered"] for r in got.collect()} == want
