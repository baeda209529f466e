"""Range joins: pairs whose times lie within a window of one another, as an equi-join on time buckets, and their counts by bin."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .parts import longest, same


def bucketed(points: DataFrame, centres: DataFrame, t: str, c: str, low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """Both with `_bucket`: buckets are as wide as the window, so each centre meets two or three and each point stands in one."""
    if high < low:
        raise ValueError("the window's end lies before its start")
    width = F.lit(float(high - low) or 1.0)
    first, last = F.floor((F.col(c) + F.lit(low)) / width), F.floor((F.col(c) + F.lit(high)) / width)
    return points.withColumn("_bucket", F.floor(F.col(t) / width)), centres.withColumn("_bucket", F.explode(F.sequence(first, last)))


def window_join(points: DataFrame, centres: DataFrame, t: str, c: str, low: float, high: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows with c + low <= t <= c + high and equal `by` columns.

    The join is linear in points, centres and pairs, hashes on (by, bucket), and a long recording spreads over its buckets;
    buckets of more than CROWDED rows on a side are dealt out.
    """
    keys = [*by, "_bucket"]
    left, right = bucketed(points, centres, t, c, low, high)
    left, right, salts = dealt_out(left, right, keys, CROWDED, points.columns, centres.columns)
    inside = (F.col(t) >= F.col(c) + F.lit(low)) & (F.col(t) <= F.col(c) + F.lit(high))
    return left.join(right, [*keys, *salts]).where(inside).drop("_bucket", *salts)


#: Rows of a bucket, on either side, that one task joins.
CROWDED = 1_000_000


def dealt_out(left: DataFrame, right: DataFrame, keys: Sequence[str], most: int, left_by: Sequence[str], right_by: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides, and the columns to join by beside the keys; none if no key has more than `most` rows on a side.

    Else the rows of such keys, bursts, are dealt out by the hash of the columns given, and copied for every share of the
    other side, so that two rows of a key meet once.
    """
    if max(longest(left, keys), longest(right, keys)) <= most:
        return left, right, []
    share = F.ceil(F.count("*") / most)
    a, b = left.groupBy(*keys).agg(share.alias("_a")), right.groupBy(*keys).agg(share.alias("_b"))
    both = same(a, b, keys)
    # a row of most keys has one share on each side: as good as no salt
    left = same(left, both, keys).withColumn("_i", F.pmod(F.xxhash64(*left_by), F.col("_a"))).withColumn("_j", F.explode(F.expr("sequence(0L, _b - 1)"))).drop("_a", "_b")
    right = same(right, both, keys).withColumn("_j", F.pmod(F.xxhash64(*right_by), F.col("_b"))).withColumn("_i", F.explode(F.expr("sequence(0L, _a - 1)"))).drop("_a", "_b")
    return left, right, ["_i", "_j"]


@dataclass(frozen=True)
class Bins:
    """Which pairs of times count, and in which of `n` bins; for arrays s and c. For a fixed c, `begun` turns true, `ended` turns
    true and `index` grows as s grows.
    """

    n: int
    begun: Callable[[np.ndarray, np.ndarray], np.ndarray]
    ended: Callable[[np.ndarray, np.ndarray], np.ndarray]
    index: Callable[[np.ndarray, np.ndarray], np.ndarray]


#: Different times of a bucket that one row holds; pairs of times looked at at once.
DENSE, AT_ONCE = 50_000, 1 << 20


def first_true(test: Callable[[np.ndarray], np.ndarray], n: int, shape: tuple[int, ...]) -> np.ndarray:
    """For each element, the first place below n where its monotone test holds, else n; a binary search of all at once."""
    low, high = np.zeros(shape, np.int64), np.full(shape, n, np.int64)
    while (low < high).any():
        middle = (low + high) >> 1
        hit = test(np.minimum(middle, n - 1)) & (middle < n)
        high, low = np.where(hit, middle, high), np.where(hit | (low >= high), low, middle + 1)
    return low


def count_bins(s: np.ndarray, s_n: np.ndarray, c: np.ndarray, c_n: np.ndarray, bins: Bins) -> np.ndarray:
    """Pairs in each bin, of ascending times s and c that occur s_n and c_n times.

    Of many points, those before each edge of each centre's bins are counted from running sums, so the work is bins times
    centres and not pairs; few points are looked at pair by pair.
    """
    out, sums = np.zeros(bins.n, np.int64), np.concatenate([[0], np.cumsum(s_n)])
    direct = len(s) <= 4 * (bins.n + 3)
    step = max(1, AT_ONCE // (len(s) if direct else bins.n + 3))
    for lo in range(0, len(c), step):
        e, times = c[lo : lo + step, None], c_n[lo : lo + step, None]
        if direct:
            at = bins.index(s[None, :], e)
            inside = bins.begun(s[None, :], e) & ~bins.ended(s[None, :], e) & (at >= 0) & (at < bins.n)
            np.add.at(out, at[inside].astype(np.int64), (times * s_n[None, :])[inside])
            continue
        begin = first_true(lambda i: bins.begun(s[i], e), len(s), e.shape)
        end = first_true(lambda i: bins.ended(s[i], e), len(s), e.shape)
        edges = np.arange(bins.n + 1)[None, :]
        at = first_true(lambda i: bins.index(s[i], e) >= edges, len(s), (len(e), bins.n + 1))
        at = np.minimum(np.maximum(at, begin), np.maximum(begin, end))
        out += ((sums[at[:, 1:]] - sums[at[:, :-1]]) * times).sum(axis=0)
    return out


def window_counts(points: DataFrame, centres: DataFrame, t: str, c: str, low: float, high: float, bins: Bins, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, n): how many pairs of the window, which holds all that count, fall in each bin; bins without pairs are left out.

    No pair becomes a row. Equal times are counted first; the times of a bucket meet in one row, and a bucket of very many,
    a burst, is dealt out by hash: each share of its points meets each share of its centres once.
    """
    keys = [*by, "_bucket"]
    left, right = bucketed(points, centres, t, c, low, high)
    left, right = (rows.groupBy(*keys, F.col(x).cast("double").alias("_t")).agg(F.count("*").alias("_n")) for rows, x in ((left, t), (right, c)))
    left, right, salts = dealt_out(left, right, keys, DENSE, ["_t"], ["_t"])
    time = F.struct("_t", "_n")
    sides = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    lists = [F.sort_array(F.collect_list(F.when(F.col("_side") == k, time))).alias(f"_x{k}") for k in (0, 1)]
    met = sides.groupBy(*keys, *salts).agg(*lists).where("size(_x0) > 0 AND size(_x1) > 0")
    flat = met.select(*by, *(F.col(f"_x{k}.{f}").alias(f"{f}{k}") for k in (0, 1) for f in ("_t", "_n")))
    kinds = "".join(f"{b} {points.schema[b].dataType.simpleString()}, " for b in by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {}
            for name in ("_t0", "_n0", "_t1", "_n1"):
                column = batch.column(name)
                lists[name] = (column.values.to_numpy(), column.offsets.to_numpy())
            found = [count_bins(*(lists[x][0][lists[x][1][i] : lists[x][1][i + 1]] for x in ("_t0", "_n0", "_t1", "_n1")), bins) for i in range(batch.num_rows)]
            row, at = np.nonzero(np.array(found).reshape(-1, bins.n))
            counts = np.array(found).reshape(-1, bins.n)[row, at]
            yield pa.RecordBatch.from_arrays([*(batch.column(b).take(pa.array(row)) for b in by), pa.array(at), pa.array(counts)], [*by, "bin", "n"])

    return flat.mapInArrow(run, f"{kinds}bin long, n long").groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def positive(value: float, name: str) -> None:
    if not value > 0:
        raise ValueError(f"{name} must be positive")


def dense_bins(groups: DataFrame, n: int | Column) -> DataFrame:
    """Each row of groups with every bin 0..n-1."""
    last = (n if isinstance(n, Column) else F.lit(n)) - 1
    return groups.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
