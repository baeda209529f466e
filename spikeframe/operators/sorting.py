"""Spike sorting in grouped Arrow functions: one electrode's recording in one group.

Filters over a long recording run in parts (`bandpass`). Lloyd's iterations of `sort_signals` take one recording of one
electrode (or one chunk of it, if `by` has a chunk column), so a group's size is set by the recording and not by the table;
`clustering.py` has the rounds as jobs over all spikes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidValues
from ..storage import checkpointed
from .parts import PART, cut_trains, same, with_halo


@dataclass(frozen=True)
class SortOptions:
    sampling_rate: float = 30_000.0
    highpass: float = 300.0
    lowpass: float = 6000.0
    threshold: float = 4.0
    length: int = 61
    pre: int = 20
    n_pca: int = 3
    max_clusters: int = 32
    min_snr: float = 3.0
    max_spikes: int = 500_000
    refractory_seconds: float = 0.001
    min_correlation: float = 0.3
    #: "compat": every component is parallel to all-ones; "svd": principal components.
    pca: str = "compat"


def filter_factors(rate: float, low: float, high: float) -> tuple[float, float]:
    """Of the first-order high pass at `low` and low pass at `high`."""
    dt = 1.0 / rate
    rc_low, rc_high = (1.0 / (2 * math.pi * max(f, 1.0)) for f in (low, high))
    return rc_low / (rc_low + dt), dt / (rc_high + dt)


def filter_from(x: np.ndarray, before: float, y: float, z: float, factors: tuple[float, float]) -> tuple[list[float], float, float]:
    """Filtered samples behind one of value `before`, from the filters' states y and z there; and the states at the end.

    Double arithmetic, state in single precision.
    """
    up, down = factors
    single, out = np.float32, []
    for now in x.astype(np.float32).astype(np.float64).tolist():
        y = float(single(up * (y + now - before)))
        z = float(single(z + down * (y - z)))
        before = now
        out.append(z)
    return out, y, z


def filter_samples(x: np.ndarray, rate: float, low: float, high: float) -> np.ndarray:
    """First-order high pass at `low`, then low pass at `high`, over a whole recording: both begin at its first sample."""
    x = x.astype(np.float32)
    if not len(x):
        return x
    first = float(x[0])
    return np.array([first, *filter_from(x[1:], first, first, first, filter_factors(rate, low, high))[0]], np.float32)


def refractory_samples(seconds: float, rate: float) -> int:
    return 0 if seconds <= 0 else max(1, math.floor(seconds * rate + 0.5))


def robust_std(x: np.ndarray, most: int = 50_000) -> float:
    if not len(x):
        return 1.0
    if len(x) > most:
        x = x[:: len(x) // most]
    x = x.astype(np.float64)
    median = np.sort(x)[len(x) // 2]
    return max(float(np.sort(np.abs(x - median))[len(x) // 2]), 1e-9) * 1.4826


def detect_peaks(x: np.ndarray, threshold: float, refractory: int, most: int) -> np.ndarray:
    a = np.abs(x)
    inner = np.flatnonzero((a[1:-1] > threshold) & (a[1:-1] >= a[:-2]) & (a[1:-1] >= a[2:])) + 1
    kept: list[int] = []
    for i in inner.tolist():
        if len(kept) >= most:
            break
        if not kept or i >= kept[-1] + refractory:
            kept.append(i)
    return np.array(kept, np.int64)


def features(snips: np.ndarray, n: int, how: str) -> np.ndarray:
    x = snips - snips.mean(axis=0)
    n = min(n, x.shape[1])
    if how == "svd":
        return x @ np.linalg.svd(x, full_matrices=False)[2][:n].T
    ones = np.full(x.shape[1], 1 / math.sqrt(x.shape[1]))
    return np.repeat((x @ ones)[:, None], n, axis=1)


def kmeans(points: np.ndarray, max_clusters: int, rounds: int = 30) -> np.ndarray:
    """Labels after a fixed number of rounds; ties to the lowest, empty clusters at zero."""
    n = len(points)
    k = max(1, min(max_clusters, n))
    centre = points[np.minimum(np.arange(k) * (n // k), n - 1)].copy()
    label = np.zeros(n, np.int64)
    for _ in range(rounds):
        distance = np.stack([((points - c) ** 2).sum(axis=1) for c in centre], axis=1)
        label = distance.argmin(axis=1)
        for c in range(k):
            some = points[label == c]
            centre[c] = some.mean(axis=0) if len(some) else 0.0
    return label


def correlations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a with each row of b; 0 where either has no energy."""
    ea, eb = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
    return np.where((ea <= 1e-12) | (eb <= 1e-12), 0.0, a @ b.T / np.maximum(np.sqrt(ea) * np.sqrt(eb), 1e-300))


def snr(waves: np.ndarray) -> float:
    if not len(waves):
        return 0.0
    mean = waves.mean(axis=0)
    return float(np.abs(mean).max()) / max(math.sqrt(float(((waves - mean) ** 2).mean())), 1e-9)


def prune(waves: np.ndarray, label: np.ndarray, min_snr: float) -> np.ndarray:
    """Snippets of weak clusters go to the strong cluster whose mean they resemble most, if two or more are strong."""
    own = {c: waves[label == c] for c in np.unique(label).tolist()}
    strong = [c for c, w in own.items() if snr(w) >= min_snr]
    if len(strong) <= 1:
        return label
    out, weak = label.copy(), ~np.isin(label, strong)
    if weak.any():
        out[weak] = np.array(strong)[correlations(waves[weak], np.stack([own[c].mean(axis=0) for c in strong])).argmax(axis=1)]
    return out


def relabel(label: np.ndarray) -> np.ndarray:
    new: dict[int, int] = {}
    return np.array([new.setdefault(c, len(new)) for c in label.tolist()], np.int64)


def sort_trace(trace: np.ndarray, o: SortOptions) -> tuple[np.ndarray, np.ndarray]:
    """Peak samples and their units; nothing if no snippet fits the trace."""
    return sort_filtered(filter_samples(trace, o.sampling_rate, o.highpass, o.lowpass), o)


def sort_filtered(x: np.ndarray, o: SortOptions) -> tuple[np.ndarray, np.ndarray]:
    """The same for a filtered trace."""
    peaks = detect_peaks(x, o.threshold * max(robust_std(x), 1e-6), refractory_samples(o.refractory_seconds, o.sampling_rate), o.max_spikes) if len(x) > 2 else np.zeros(0, np.int64)
    first = np.maximum(peaks - o.pre, 0)
    peaks, first = peaks[first + o.length <= len(x)], first[first + o.length <= len(x)]
    if not len(peaks):
        return peaks, peaks
    waves = np.stack([x[a : a + o.length] for a in first]).astype(np.float64)
    label = relabel(prune(waves, kmeans(features(waves, o.n_pca, o.pca), o.max_clusters), o.min_snr))
    templates = np.stack([waves[label == c].mean(axis=0).astype(np.float32).astype(np.float64) for c in range(label.max() + 1)])
    found = correlations(waves, templates)
    best = found.shape[1] - 1 - found[:, ::-1].argmax(axis=1)  # of equal ones the last
    return peaks, np.where(found[np.arange(len(found)), best] >= o.min_correlation, best, label)


def _grouped(signal: DataFrame, by: Sequence[str], order: Sequence[str], value: str, run, extra: str, columns) -> DataFrame:
    kinds = ", ".join(f"{c} {signal.schema[c].dataType.simpleString()}" for c in by)

    def each(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in order])
        made = run(group.column(value).to_numpy())
        n = len(next(iter(made.values())))
        keys = {c: pa.array([group.column(c)[0].as_py()] * n, group.schema.field(c).type) for c in by}
        return pa.table(keys | {c: pa.array(made[c], t) for c, t in columns.items()})

    keep = list(dict.fromkeys([*by, *order, value]))
    return signal.select(*keep).groupBy(*by).applyInArrow(each, f"{kinds}, {extra}")


def bandpass(signal: DataFrame, rate: float, low: float, high: float, by: Sequence[str], order: Sequence[str], value: str = "value", part_rows: int | None = None, warm_up: int = 4_096) -> DataFrame:
    """(by, sample, filtered) of every recording.

    A long recording is cut in parts. Each part guesses the filters' state at its border by running over the `warm_up`
    samples before it, and says its state at its end. Where a guess is not, to the bit, the end of the part before, that
    part is run again from there, until no border differs: filters forget, so this seldom goes on beyond one part. Then
    all parts run from known states, which gives the samples of one long run.
    """
    cut = cut_trains(signal.select(*by, *order, F.col(value).cast("float").alias(value)), by, order, before=0, part_rows=part_rows)
    if cut.whole:

        def run(x: np.ndarray) -> dict:
            return {"sample": np.arange(len(x)), "filtered": filter_samples(x, rate, low, high)}

        return _grouped(signal, by, order, value, run, "sample long, filtered float", {"sample": pa.int64(), "filtered": pa.float32()})
    part_rows = PART if part_rows is None else part_rows
    halo = min(max(warm_up, 1), part_rows)
    numbers = checkpointed(cut.rows.select(*by, "_i", F.col(value).alias("_x")))
    rows = with_halo(numbers, F.col("_i"), halo, 0, part_rows)
    states = checkpointed(_by_part(rows, by, low, high, rate, None, part_rows).where("_in_y IS NOT NULL OR _part = 0"))
    train = Window.partitionBy(*by).orderBy("_part")  # one row a part
    while True:
        borders = states.withColumns({"_y": F.lag("_out_y").over(train), "_z": F.lag("_out_z").over(train)})
        off = checkpointed(borders.where("_part > 0 AND NOT (_in_y <=> _y AND _in_z <=> _z)").select(*by, "_part", "_y", "_z"))
        if off.isEmpty():
            break
        # of parts in a row, the first has its true beginning; the next ones may be right again by then
        redone = _by_part(same(rows, off, [*by, "_part"]), by, low, high, rate, "states", part_rows)
        states = checkpointed(same(states, off.select(*by, "_part"), [*by, "_part"], "left_anti").unionByName(redone))
    known = states.select(*by, "_part", F.col("_in_y").alias("_y"), F.col("_in_z").alias("_z"))
    return _by_part(same(rows, known, [*by, "_part"]), by, low, high, rate, "samples", part_rows)


def _by_part(rows: DataFrame, by: Sequence[str], low: float, high: float, rate: float, given: str | None, part_rows: int) -> DataFrame:
    """Runs the filters over each part: from a guess or from the states given in _y and _z; gives (by, _part, states) or the samples."""
    factors = filter_factors(rate, low, high)
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("_i")
        i, x, part = group.column("_i").to_numpy(), group.column("_x").to_numpy().astype(np.float32), group.column("_part")[0].as_py()
        own = int(np.searchsorted(i, part * part_rows))  # what stands before is the halo
        first = float(x[0])
        if own == len(x):  # a halo behind the last part
            y = z = end_y = end_z = None
            out = []
        elif own == 0:
            y = z = first
            out, end_y, end_z = filter_from(x[1:], first, first, first, factors)
            out = [first, *out]
        else:
            if given:
                y, z = group.column("_y")[0].as_py(), group.column("_z")[0].as_py()
            else:
                _, y, z = filter_from(x[1:own], first, first, first, factors)
            out, end_y, end_z = filter_from(x[own:], float(x[own - 1]), y, z, factors)
        keys = lambda n: {c: pa.array([group.column(c)[0].as_py()] * n, group.schema.field(c).type) for c in by}
        if given == "samples":
            return pa.table(keys(len(out)) | {"sample": pa.array(i[own:], pa.int64()), "filtered": pa.array(out, pa.float32())})
        return pa.table(keys(1) | {"_part": pa.array([part], pa.int64())} | {c: pa.array([v], pa.float64()) for c, v in (("_in_y", y), ("_in_z", z), ("_out_y", end_y), ("_out_z", end_z))})

    shape = "sample long, filtered float" if given == "samples" else "_part long, _in_y double, _in_z double, _out_y double, _out_z double"
    return rows.groupBy(*by, "_part").applyInArrow(run, f"{kinds}{shape}")


def sort_signals(signal: DataFrame, options: SortOptions, by: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """(by, sample, t, unit): the spikes of every recording and the unit each belongs to."""

    def run(x: np.ndarray) -> dict:
        peaks, label = sort_trace(x, options)
        return {"sample": peaks, "t": peaks / options.sampling_rate, "unit": label}

    return _grouped(signal, by, order, value, run, "sample long, t double, unit long", {"sample": pa.int64(), "t": pa.float64(), "unit": pa.int64()})


def sort_channels(channels: DataFrame, options: SortOptions, by: Sequence[str] = ("session_id",), channel: str = "channel", pos: str = "pos", value: str = "value", per_channel: bool = False) -> DataFrame:
    """Sorts several channels: the first less the mean of all, or each for itself less that mean.

    Channels of one recording must be of one length and, if `channels` has a column sampling_rate, of the options' rate.
    """
    if "sampling_rate" in channels.columns and not channels.where(~F.col("sampling_rate").eqNullSafe(F.lit(float(options.sampling_rate)))).isEmpty():
        raise InvalidValues("channels of one recording differ in sampling rate")
    filtered = bandpass(channels, options.sampling_rate, options.highpass, options.lowpass, [*by, channel], [pos], value)
    lengths = filtered.groupBy(*by, channel).agg(F.count("*").alias("_n")).groupBy(*by).agg(F.min("_n").alias("least"), F.max("_n").alias("most"))
    if not lengths.where("least <> most").isEmpty():
        raise InvalidValues("channels of one recording differ in length")
    mean = filtered.groupBy(*by, "sample").agg(F.avg("filtered").alias("_mean"), F.min(channel).alias("_first"), F.count("*").alias("_n"))
    own = filtered.join(mean, [*by, "sample"])
    if not per_channel:
        own = own.where(F.col(channel) == F.col("_first"))
    referenced = own.withColumn("value", F.when(F.col("_n") > 1, F.col("filtered") - F.col("_mean")).otherwise(F.col("filtered")).cast("float"))

    def run(x: np.ndarray) -> dict:
        peaks, label = sort_filtered(x.astype(np.float32), options)
        return {"sample": peaks, "t": peaks / options.sampling_rate, "unit": label}

    return _grouped(referenced, [*by, channel], ["sample"], "value", run, "sample long, t double, unit long", {"sample": pa.int64(), "t": pa.float64(), "unit": pa.int64()})


def units(spikes: DataFrame, prefix: str = "unit_", by: Sequence[str] | None = None) -> DataFrame:
    """(by, var_name, idx, t): sorted spikes as neurons, one for each unit of each recording.

    `by` names the recording's columns; without it, all columns of `spikes` beside sample, t and unit.
    """
    by = [c for c in spikes.columns if c not in ("sample", "t", "unit")] if by is None else list(by)
    name = F.concat(F.lit(prefix), F.col("unit").cast("string"))
    return spikes.select(*by, name.alias("var_name"), (F.row_number().over(Window.partitionBy(*by, "unit").orderBy("t")) - 1).cast("long").alias("idx"), "t")
