"""Spike-train analyses over points (unit columns, t) and events (t)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import EPSILON, bin_index
from .parts import PART, cut_trains, longest, with_halo
from .range_join import Bins, dense_bins, positive, window_counts, window_join


def in_range(points: DataFrame, start: float, end: float) -> DataFrame:
    """Both ends included."""
    return points.where(F.col("t").between(start, end))


def sorted_points(points: DataFrame) -> DataFrame:
    return points.orderBy("t")


def first_points(points: DataFrame, n: int) -> DataFrame:
    return points.where(F.col("idx") < n)


def point_range(points: DataFrame, start: int, count: int) -> DataFrame:
    return points.where((F.col("idx") >= start) & (F.col("idx") < start + count))


def psth(spikes: DataFrame, events: DataFrame, start: float = -0.5, end: float = 1.0, bin_width: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, bin_start, count, rate_hz, n_events): spikes around events, for each group that has events.

    A spike counts in each event's window, from `start` to `end` without the end, repeated events too. The last bin's rate
    is over a whole bin. Without events (and `by`) there is one group of zero counts and rates.
    """
    positive(bin_width, "bin_width")
    if end <= start:
        raise ValueError("the window's end must lie after its start")
    n = max(1, math.ceil((end - start) / bin_width))
    bins = Bins(
        n, lambda s, e: (s >= e + start) & (s - e >= start), lambda s, e: (s > e + end) | (s - e >= end),
        lambda s, e: np.floor((s - e - start) / bin_width),
    )
    counts = window_counts(spikes.select(*by, F.col("t").alias("_s")), events.select(*by, F.col("t").alias("_e")), "_s", "_e", start, end, bins, by)
    groups = events.groupBy(*by).agg(F.count("*").alias("n_events"))
    count = F.coalesce("n", F.lit(0).cast("long"))
    return dense_bins(groups, n).join(counts, [*by, "bin"], "left").select(
        *by, "bin", (F.lit(start) + F.col("bin") * F.lit(bin_width)).alias("bin_start"), count.alias("count"),
        F.when(F.col("n_events") > 0, count / (F.col("n_events") * F.lit(bin_width))).otherwise(0.0).alias("rate_hz"), "n_events",
    )


def raster(spikes: DataFrame, events: DataFrame, start: float = -0.5, end: float = 1.0, by: Sequence[str] = (), event_key: str = "idx") -> DataFrame:
    """(by, event_key, trial): the times of the spikes around each event, ascending; both ends included, empty trials kept."""
    asked = events.select(*by, event_key, F.col("t").alias("_e"))
    pairs = window_join(spikes.select(*by, F.col("t").alias("_s")), asked, "_s", "_e", start, end, by)
    trials = pairs.groupBy(*by, event_key).agg(F.sort_array(F.collect_list(F.col("_s") - F.col("_e"))).alias("trial"))
    return asked.select(*by, event_key).join(trials, [*by, event_key], "left").withColumn("trial", F.coalesce("trial", F.array().cast("array<double>")))


def intervals_between(points: DataFrame, by: Sequence[str] = ("unit",), order: Sequence[str] = ("t",), part_rows: int | None = None) -> DataFrame:
    """The rows that have a predecessor in their train, with `isi`, the time since it. A long train is cut in parts."""
    cut = cut_trains(points, by, order, before=1, part_rows=part_rows)
    return cut.own(cut.rows.withColumn("isi", F.col("t") - F.lag("t").over(cut.window)).where(F.col("isi").isNotNull()))


def isi_histogram(points: DataFrame, bin_width: float, by: Sequence[str] = ("unit",), order: Sequence[str] = ("t",)) -> DataFrame:
    """(by, bin, bin_start, count): bins up to one beyond the largest interval; trains of fewer than two spikes have none."""
    positive(bin_width, "bin_width")
    isi = intervals_between(points, by, order)
    counts = isi.groupBy(*by, bin_index(F.col("isi"), 0.0, bin_width).alias("bin")).agg(F.count("*").alias("n"))
    groups = isi.groupBy(*by).agg((F.ceil(F.max("isi") / F.lit(bin_width)) + 1).alias("_n"))
    return dense_bins(groups, F.col("_n")).join(counts, [*by, "bin"], "left").select(*by, "bin", (F.col("bin") * F.lit(bin_width)).alias("bin_start"), F.coalesce("n", F.lit(0).cast("long")).alias("count"))


def cross_correlogram(a: DataFrame, b: DataFrame, max_lag: float, bin_width: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, bin_start, count) of the lags a - b up to max_lag; a train against itself includes the pairs of a spike with itself."""
    positive(max_lag, "max_lag")
    positive(bin_width, "bin_width")
    n = math.ceil(2 * max_lag / bin_width)
    bins = Bins(n, lambda s, e: s - e >= -max_lag, lambda s, e: s - e > max_lag, lambda s, e: np.floor((s - e + max_lag) / bin_width))
    # the bucket's window is a little wider, so that rounding loses no pair; the exact test follows
    wide = max_lag * (1 + 1e-9) + 1e-9
    counts = window_counts(a.select(*by, F.col("t").alias("_s")), b.select(*by, F.col("t").alias("_e")), "_s", "_e", -wide, wide, bins, by)
    groups = a.select(*by).distinct() if by else a.sparkSession.range(1).select()
    return dense_bins(groups, n).join(counts, [*by, "bin"], "left").select(*by, "bin", (F.lit(-max_lag) + F.col("bin") * F.lit(bin_width)).alias("bin_start"), F.coalesce("n", F.lit(0).cast("long")).alias("count"))


def gaussian_weights(sigma: float) -> list[float]:
    r = 3 * math.ceil(sigma)
    w = [math.exp(-0.5 * ((i - r) / max(sigma, EPSILON)) ** 2) for i in range(2 * r + 1)]
    total = 0.0
    for x in w:
        total += x
    return [x / total for x in w]


def smooth_rate(bins: DataFrame, bin_width: float, sigma: float, by: Sequence[str] = (), part_rows: int | None = None) -> DataFrame:
    """`bins` (by, bin, count), dense, with `rate`: counts under a Gaussian of `sigma` bins, over the bin width.

    Bins beyond the ends count as nothing and the weights are not made up for them. Terms are added in the order of bins.
    Where a group has more than `part_rows` bins, it is cut in parts that hold copies of the bins around them.
    """
    if bin_width <= 0:
        return bins.withColumn("rate", F.lit(None).cast("double")).limit(0)
    w = gaussian_weights(sigma)
    r = len(w) // 2
    part_rows = max(r, PART if part_rows is None else part_rows)
    cut = longest(bins, by) > part_rows
    train = Window.partitionBy(*by, *(["_part"] if cut else [])).orderBy("bin")
    if cut:
        first = bins.agg(F.min("bin")).first()[0]
        bins = with_halo(bins, F.col("bin") - F.lit(first), r, r, part_rows)
    total: Column = F.lit(0.0)
    for k, x in enumerate(w):
        total = total + F.lag("count", r - k, 0).over(train) * F.lit(x) if k < r else total + (F.col("count") if k == r else F.lead("count", k - r, 0).over(train)) * F.lit(x)
    out = bins.withColumn("rate", total / F.lit(bin_width))
    return out.where("_own").drop("_part", "_own") if cut else out


def units_by_rate(variables: DataFrame, points: DataFrame, beg: float, end: float) -> DataFrame:
    """(session_id, var_name, n_spikes, rate_hz, rank): a session's neurons by mean rate, highest first; equal rates in file
    order, silent units too. Tables without session_id are one session.
    """
    by = ["session_id"] if "session_id" in variables.columns else []
    n = points.groupBy(*by, "var_name").agg(F.count("*").alias("n"))
    rate = F.col("n_spikes") / F.lit(max(end - beg, EPSILON))
    units = variables.where("kind = 'neuron'").join(n, [*by, "var_name"], "left").select(*by, "var_name", "var_index", F.coalesce("n", F.lit(0).cast("long")).alias("n_spikes"))
    order = Window.partitionBy(*by).orderBy(F.desc("rate_hz"), "var_index")  # one row a unit
    return units.withColumn("rate_hz", rate).withColumn("rank", F.row_number().over(order)).drop("var_index")
