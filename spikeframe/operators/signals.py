"""Sampled signals and waveforms: fragments, peaks, snippets, templates, robust spread, references."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidValues
from ..functions import normalized_correlation, ordered_sum
from ..storage import checkpointed
from .parts import cut_trains, longest, numbered, part_sums, same


def fragments(samples: DataFrame, step: int, by: Sequence[str] = ("unit",), tick: str = "tick", part_rows: int | None = None) -> DataFrame:
    """(by, fragment, first_tick, first_index, count): runs of samples whose ticks are `step` apart.

    Of a long train each part finds the samples that begin a run; their numbers, and the next one behind the part's last,
    come from the counts and first beginnings of the parts.
    """
    cut = cut_trains(samples.select(*by, tick), by, [tick], before=1, part_rows=part_rows)
    gap = F.lag(tick).over(cut.window)
    marked = cut.rows.withColumn("_new", gap.isNull() | (F.col(tick) != gap + step))
    if cut.whole:
        runs = marked.withColumn("fragment", F.sum(F.col("_new").cast("long")).over(cut.window.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        return runs.groupBy(*by, "fragment").agg(F.min(tick).alias("first_tick"), F.min("_i").alias("first_index"), F.count("*").alias("count"))
    own = marked.where("_own")
    parts = own.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.count_if("_new").alias("_starts"), F.min(F.when(F.col("_new"), F.col("_i"))).alias("_first"))
    train = Window.partitionBy(*by).orderBy("_part")  # one row a part
    behind = F.first("_first", ignorenulls=True).over(train.rowsBetween(1, Window.unboundedFollowing))
    parts = part_sums(parts, by, _before="_starts").withColumn("_next", F.coalesce(behind, F.sum("_n").over(Window.partitionBy(*by))))
    part = Window.partitionBy(*by, "_part").orderBy("_i")
    starts = same(own.where("_new"), parts.select(*by, "_part", "_before", "_next"), [*by, "_part"])
    fragment = F.row_number().over(part) - 1 + F.col("_before")
    count = F.coalesce(F.lead("_i").over(part), F.col("_next")) - F.col("_i")
    return starts.select(*by, fragment.cast("long").alias("fragment"), F.col(tick).alias("first_tick"), F.col("_i").alias("first_index"), count.cast("long").alias("count"))


def fragment_counts(starts: DataFrame, total: str = "n_samples", by: Sequence[str] = ("unit",), index: str = "first_index") -> DataFrame:
    """Each fragment's length: up to the next one's first index, of the last up to `total`."""
    nxt = F.lead(index).over(Window.partitionBy(*by).orderBy(index))
    return starts.withColumn("count", (F.coalesce(nxt, F.col(total)) - F.col(index)).cast("long"))


def local_peaks(samples: DataFrame, threshold: float, by: Sequence[str] = ("unit",), order: Sequence[str] = ("t",), value: str = "value", part_rows: int | None = None) -> DataFrame:
    """Samples above the threshold in size and no smaller than both neighbours; first and last samples never. Long trains are cut in parts."""
    cut = cut_trains(samples, by, order, before=1, after=1, part_rows=part_rows)
    x, before, after = F.abs(value), F.abs(F.lag(value).over(cut.window)), F.abs(F.lead(value).over(cut.window))
    marked = cut.rows.withColumns({"sample": F.col("_i"), "_peak": (x > threshold) & (x >= before) & (x >= after)})
    return cut.own(marked.where("_peak").drop("_peak"))


def _first_kept(samples: np.ndarray, refractory: int, at: int) -> list[int]:
    """Places of the peaks kept if the one at `at` is."""
    follow = np.searchsorted(samples, samples + refractory).tolist()
    kept = []
    while at < len(follow):
        kept.append(at)
        at = max(follow[at], at + 1)
    return kept


def _exits(samples: np.ndarray, refractory: int) -> tuple[list[int], list[int]]:
    """For every peak of a part that may be its first kept one: the peak, and the last one kept after it."""
    follow = np.searchsorted(samples, samples + refractory).tolist()
    # the part before ends ahead of the first peak, so one within its refractory time is kept, or the first behind that
    n = min(len(follow), max(follow[0], 1) + 1)
    last: dict[int, int] = {}
    for start in range(n - 1, -1, -1):
        path, at = [], start
        while at < len(follow) and at not in last:
            path.append(at)
            at = max(follow[at], at + 1)
        end = last[at] if at < len(follow) else path[-1]
        last.update((p, end) for p in path)
    return samples[:n].tolist(), [int(samples[last[i]]) for i in range(n)]


def suppress_refractory(peaks: DataFrame, refractory: int, by: Sequence[str] = ("unit",), sample: str = "sample", most: int | None = None, part_rows: int | None = None) -> DataFrame:
    """(by, sample): each peak at least `refractory` samples after the last one kept, up to `most` of them.

    A train is folded in a grouped Arrow function, one step a kept peak. A long train is cut in parts. What happened before
    a part matters only for which of its first peaks is kept, so each part says, for every peak that may be the first, which
    is then the last one kept; going through these from part to part gives each part its beginning, and all fold at once.
    """
    rows = peaks.select(*by, F.col(sample).cast("long").alias(sample))
    cut = cut_trains(rows, by, [sample], part_rows=part_rows)
    kinds = "".join(f"{c} {peaks.schema[c].dataType.simpleString()}, " for c in by)

    def keyed(group: pa.Table, keys: Sequence[str], n: int, **columns: list[int]) -> pa.Table:
        own = {c: pa.array([group.column(c)[0].as_py()] * n, group.schema.field(c).type) for c in keys}
        return pa.table(own | {c: pa.array(v, pa.int64()) for c, v in columns.items()})

    def fold(group: pa.Table) -> pa.Table:
        x = np.sort(group.column(sample).to_numpy())
        first = group.column("_first")[0].as_py() if "_first" in group.column_names else x[0]
        kept = x[_first_kept(x, refractory, int(np.searchsorted(x, first)))] if first is not None else x[:0]
        return keyed(group, by, len(kept), **{sample: kept.tolist()})

    if cut.whole:
        kept = cut.rows.select(*by, sample).groupBy(*by).applyInArrow(fold, f"{kinds}{sample} long")
    else:

        def ends(group: pa.Table) -> pa.Table:
            enter, leave = _exits(np.sort(group.column(sample).to_numpy()), refractory)
            return keyed(group, [*by, "_part"], len(enter), enter=enter, leave=leave)

        def carry(group: pa.Table) -> pa.Table:
            group = group.sort_by([("_part", "ascending"), ("enter", "ascending")])
            part, enter, leave = (group.column(c).to_numpy() for c in ("_part", "enter", "leave"))
            cuts = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
            last, first = None, []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
                at = a if last is None else a + int(np.searchsorted(enter[a:b], last + refractory))
                first.append(int(enter[at]) if at < b else None)
                last = int(leave[at]) if at < b else last
            return keyed(group, by, len(cuts), _part=part[cuts].tolist(), _first=first)

        table = cut.rows.select(*by, "_part", sample)
        borders = table.groupBy(*by, "_part").applyInArrow(ends, f"{kinds}_part long, enter long, leave long")  # as many rows a part as peaks fit the refractory time
        begin = borders.groupBy(*by).applyInArrow(carry, f"{kinds}_part long, _first long")
        kept = same(table, begin, [*by, "_part"]).groupBy(*by, "_part").applyInArrow(fold, f"{kinds}{sample} long")
    if most is not None:
        kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(sample))).where(F.col("_r") <= most).drop("_r")
    return kept


def snippets(signals: DataFrame, peaks: DataFrame, pre: int, length: int, by: Sequence[str] = ("unit",), sample: str = "sample", values: str = "values") -> DataFrame:
    """`length` samples from max(0, peak - pre); those that would pass the end are dropped."""
    first = F.greatest(F.col(sample) - pre, F.lit(0))
    both = peaks.join(signals, list(by)).where(first + length <= F.size(values))
    return both.withColumn("snippet", F.slice(values, (first + 1).cast("int"), length)).drop(values)


#: Waveforms added up in order before partial sums are, also in order.
SUMMED = 4_096


def _block_sums(rows: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """(by, _s, _n): sum and number of values: in the order of `order` within blocks of SUMMED numbers, then block by block.

    No row gathers more than a block, or the sums of all blocks; the result does not depend on how rows are dealt.
    """
    blocks = rows.withColumn("_block", F.floor(F.col(order) / SUMMED)).groupBy(*by, "_block").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("_v"))
    sums = blocks.select(*by, "_block", ordered_sum(F.transform("_v", lambda v: v["v"])).alias("s"), F.size("_v").cast("long").alias("n"))
    every = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_block", "s", "n"))).alias("_b"))
    return every.select(*by, ordered_sum(F.transform("_b", lambda b: b["s"])).alias("_s"), F.aggregate("_b", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("_n"))


def mean_waveforms(waves: DataFrame, label: str = "label", samples: str = "samples", order: str = "idx") -> DataFrame:
    """(label, template): the mean of each sample over a label's waveforms, added up in blocks by `order`, a whole number."""
    points = waves.select(label, order, F.posexplode(samples).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    mean = _block_sums(points, [label, "pos"], order, "x").select(label, "pos", (F.col("_s") / F.col("_n")).alias("mean"))
    return mean.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "mean"))), lambda v: v["mean"]).alias("template"))


#: Templates that may sit in one broadcast row.
MOST_TEMPLATES = 10_000


def _with_templates(waves: DataFrame, templates: DataFrame, key: str, samples: str) -> DataFrame:
    """(key, samples, _t): each waveform with all templates; their number is checked before they are broadcast."""
    if (n := templates.count()) > MOST_TEMPLATES:
        raise InvalidValues(f"{n} templates; at most {MOST_TEMPLATES} are compared with every waveform")
    row = templates.agg(F.sort_array(F.collect_list(F.struct(F.col("label").alias("label"), F.col("template")))).alias("_t"))
    return waves.select(key, samples).join(F.broadcast(row))


def template_correlations(waves: DataFrame, templates: DataFrame, key: str = "idx", samples: str = "samples") -> DataFrame:
    """(key, template_label, corr) for each waveform and template."""
    each = _with_templates(waves, templates, key, samples).select(key, samples, F.explode("_t").alias("_t"))
    return each.select(key, F.col("_t.label").alias("template_label"), normalized_correlation(F.col(samples), F.col("_t.template")).alias("corr"))


def nearest_template(waves: DataFrame, templates: DataFrame, key: str = "idx", samples: str = "samples") -> DataFrame:
    """(key, template_label, corr): the best-correlated template, found within the waveform's row; of equal ones the last."""
    best = F.array_max(F.transform("_t", lambda t: F.struct(normalized_correlation(F.col(samples), t["template"]).alias("corr"), t["label"].alias("label"))))
    found = _with_templates(waves, templates, key, samples).where(F.size("_t") > 0).select(key, best.alias("_b"))
    return found.select(key, F.col("_b.label").alias("template_label"), F.col("_b.corr").alias("corr"))


def cluster_snr(waves: DataFrame, templates: DataFrame, label: str = "label", samples: str = "samples", order: str = "idx") -> DataFrame:
    """(label, snr): the template's largest size over the root mean square of the residuals."""
    sq = ordered_sum(F.zip_with(samples, "template", lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)))
    both = waves.join(templates, label).select(label, order, sq.alias("sq"), F.size(samples).alias("n"))
    length = both.groupBy(label).agg(F.sum("n").alias("_m"))
    rmse = F.sqrt(F.col("_s") / F.col("_m"))
    return _block_sums(both, [label], order, "sq").join(length, label).join(templates, label).select(label, (F.array_max(F.transform("template", lambda x: F.abs(x))) / F.greatest(rmse, F.lit(1e-9))).alias("snr"))


def _ordered_bits(value: str):
    """Adds _bits: a whole number in the order of the doubles; -0.0 is 0.0, NaN comes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(value).to_numpy(zero_copy_only=False) + 0.0
            bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
            bits = np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)
            at = batch.schema.get_field_index(value)
            yield batch.set_column(at, "_bits", pa.array(np.where(np.isnan(x), np.int64(2**63 - 1), bits)))

    return run


def _doubles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = batch.column("_bits").to_numpy()
        x = np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits).view(np.float64)
        yield batch.set_column(batch.schema.get_field_index("_bits"), "_found", pa.array(x))


#: Bits of a value that a pass of the selection looks at, and groups whose table of prefixes may be broadcast.
DIGIT, MOST_GROUPS = 16, 100_000


def order_statistic(rows: DataFrame, rank: Column, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(by, n, _found): of the n non-null doubles of each group, the one at `rank`, a column over `n` that counts from 0.

    A radix selection: four passes count values by sixteen bits of their order, from the highest, among those that share the
    bits found so far. Counts are made before the shuffle, so no task holds or sorts a group.
    """
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in by)
    bits = rows.select(*by, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull()).mapInArrow(_ordered_bits(value), f"{kinds}_bits long")
    found = bits.groupBy(*by).agg(F.count("*").alias("n")).withColumns({"_rank": rank.cast("long"), "_prefix": F.lit(0).cast("long")})
    for shift in range(64 - DIGIT, -1, -DIGIT):
        found = checkpointed(found)
        small = F.broadcast(found) if not by or found.count() <= MOST_GROUPS else found
        # the highest digit keeps its sign, and so do prefixes
        digit = F.shiftright("_bits", shift)
        some = same(bits, small.select(*by, "_prefix"), by) if shift < 64 - DIGIT else bits
        if shift < 64 - DIGIT:
            some = some.where(F.shiftright("_bits", shift + DIGIT) == F.col("_prefix"))
        counts = some.groupBy(*by, digit.alias("_digit")).agg(F.count("*").alias("_c"))
        order = Window.partitionBy(*by).orderBy("_digit")  # 65,536 rows a group at most
        upto = counts.withColumn("_upto", F.sum("_c").over(order))
        at = same(upto, small.select(*by, "n", "_rank"), by).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c")))
        found = at.select(*by, "n", (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_rank"), F.col("_digit").alias("_prefix"))
    last = found.select(*by, "n", F.col("_prefix").alias("_bits"))
    return last.mapInArrow(_doubles, f"{kinds}n long, _found double")


def robust_sigma(samples: DataFrame, by: Sequence[str] = (), value: str = "value", order: Sequence[str] = ("t",), most: int | None = 50_000) -> DataFrame:
    """(by, median, sigma): 1.4826 times the median distance from the median, both upper medians. At least 1e-9 times the factor.

    Of more than `most` samples, every (n div most)-th counts, so medians are of fewer than twice `most` values each. With
    `most` None all samples count, by radix selection.
    """
    x = samples.select(*by, *(order if most is not None else ()), F.col(value).cast("double").alias("_x"))
    if most is None:
        upper = F.floor(F.col("n") / 2)
        middle = checkpointed(order_statistic(x, upper, by, "_x").select(*by, F.col("_found").alias("median")))
        small = F.broadcast(middle) if not by or middle.count() <= MOST_GROUPS else middle
        away = same(x, small, by).select(*by, F.abs(F.col("_x") - F.col("median")).alias("_d"))
        spread = order_statistic(away, upper, by, "_d").select(*by, F.col("_found").alias("_mad"))
        return same(middle, spread, by).select(*by, "median", (F.greatest("_mad", F.lit(1e-9)) * F.lit(1.4826)).alias("sigma"))
    if longest(x, by) > most:
        n = x.groupBy(*by).agg(F.count("*").alias("_n"))
        placed = same(numbered(x, by, order, "_i"), n if by else F.broadcast(n), by)  # n: one row without `by`
        x = placed.where((F.col("_n") <= most) | (F.col("_i") % F.floor(F.col("_n") / most) == 0))
    lists = x.groupBy(*by).agg(F.sort_array(F.collect_list("_x")).alias("_x"))  # of fewer than 2 * most values
    middle = lists.withColumn("median", F.element_at("_x", (F.floor(F.size("_x") / 2) + 1).cast("int")))
    mad = F.element_at(F.sort_array(F.transform("_x", lambda x: F.abs(x - F.col("median")))), (F.floor(F.size("_x") / 2) + 1).cast("int"))
    return middle.select(*by, "median", (F.greatest(mad, F.lit(1e-9)) * F.lit(1.4826)).alias("sigma"))


def common_average_reference(channels: DataFrame, channel: str = "channel", pos: str = "pos", value: str = "value", first: int = 0) -> DataFrame:
    """(pos, value): the first channel less the mean of all at each sample; a single channel stays as it is.

    Channels, numbered by whole numbers, are added up in blocks, so that a sample of very many channels fills no row.
    """
    x = channels.select(pos, channel, F.col(value).cast("double").alias("_x"))
    sums = _block_sums(x, [pos], channel, "_x")
    own = x.where(F.col(channel) == first).select(pos, F.col("_x").alias("_own"))
    mean = F.col("_s") / F.col("_n")
    return sums.join(own, pos, "left").select(pos, F.when(F.col("_n") > 1, F.col("_own") - mean).otherwise(F.col("_own")).alias("value"))


def relabel_contiguous(labels: DataFrame, label: str = "label", order: str = "idx") -> DataFrame:
    """Labels renumbered from 0 by first appearance."""
    first = labels.groupBy(label).agg(F.min(order).alias("_f"))
    ranks = first.withColumn("new_label", F.row_number().over(Window.orderBy("_f")) - 1)  # one row a label
    return labels.join(ranks.drop("_f"), label)
