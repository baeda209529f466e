"""Long trains over many tasks: rows are numbered over range partitions that are written once, then cut by number.

A part holds `part_rows` rows of one train and copies of its neighbours' border rows (the halo), so that windows, filters
and folds run within parts; what goes on from part to part (sums, states) is carried in tables of one row a part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import checkpointed

#: Rows of a train that one task takes.
PART = 1 << 20


def same(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; the keys of `a` stay."""
    renamed = b.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)), *(c for c in b.columns if c not in keys))
    on = F.lit(True)
    for i, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return a.join(renamed, on, how).drop(*(f"_k{i}" for i in range(len(keys))))


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows with their number from 0 within `by`, in the order of `order`; no task holds a whole group.

    Rows are range-partitioned by (by, order) and written with the number of their partition, so that counts and rows speak
    of the same partitions. A group that goes on from the partition before adds the rows it has there: one row a partition.
    """
    keys = [*by, *order]
    dealt = checkpointed(rows.repartitionByRange(*keys).withColumns({"_p": F.spark_partition_id(), "_u": F.monotonically_increasing_id()}))
    counts = dealt.groupBy("_p", *by).agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition and group
    offsets = counts.withColumn("_before", F.sum("_c").over(before)).where("_before > 0").drop("_c")
    # of the groups of a partition only its first can have begun before: as many rows as partitions
    within = F.row_number().over(Window.partitionBy("_p", *by).orderBy(*order, "_u")) - 1  # equal rows in the order written
    placed = same(dealt.withColumn("_w", within), F.broadcast(offsets), ["_p", *by], "left")
    return placed.withColumn(name, (F.col("_w") + F.coalesce("_before", F.lit(0))).cast("long")).drop("_p", "_u", "_w", "_before")


#: Rows of the longest train up to which a plain window numbers it.
SHORT = 1 << 17


def numbered_once(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """The rows of `numbered`, written once with their numbers where a train is long, so that all that is made of them reads them there."""
    if longest(rows, by) > SHORT:
        return checkpointed(numbered(rows, by, order, name))
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1)


@dataclass(frozen=True)
class Trains:
    """`rows` with their number `_i`, part `_part` and whether they are the part's own (`_own`), not its halo's; `window` goes over a part in order."""

    rows: DataFrame
    window: WindowSpec
    whole: bool

    def own(self, rows: DataFrame) -> DataFrame:
        return rows.where("_own").drop("_i", "_part", "_own")


def longest(rows: DataFrame, by: Sequence[str]) -> int:
    """Rows of the longest train."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0


def with_halo(rows: DataFrame, at: Column, before: int, after: int, part_rows: int) -> DataFrame:
    """Rows numbered by `at`, in their part and as copies in the parts that need up to `before` rows ahead or `after` behind."""
    if max(before, after) > part_rows:
        raise ValueError("a part has fewer rows than its halo")
    part, place = F.floor(at / part_rows), at % part_rows
    copies = [F.struct(part.alias("p"), F.lit(True).alias("own"))]
    if before:
        copies.append(F.when(place >= part_rows - before, F.struct((part + 1).alias("p"), F.lit(False).alias("own"))))
    if after:
        copies.append(F.when((place < after) & (part > 0), F.struct((part - 1).alias("p"), F.lit(False).alias("own"))))
    dealt = rows.withColumn("_to", F.explode(F.array_compact(F.array(*copies))))
    return dealt.withColumn("_part", F.col("_to.p")).withColumn("_own", F.col("_to.own")).drop("_to")


def cut_trains(rows: DataFrame, by: Sequence[str], order: Sequence[str], before: int = 0, after: int = 0, part_rows: int | None = None) -> Trains:
    """The trains in parts; where none is longer than a part, each train is one, and nothing is written."""
    part_rows = PART if part_rows is None else part_rows
    if longest(rows, by) <= part_rows:
        train = Window.partitionBy(*by).orderBy(*order)
        return Trains(rows.withColumns({"_i": (F.row_number().over(train) - 1).cast("long"), "_part": F.lit(0).cast("long"), "_own": F.lit(True)}), train, True)
    placed = with_halo(numbered(rows, by, order, "_i"), F.col("_i"), before, after, part_rows)
    return Trains(placed, Window.partitionBy(*by, "_part").orderBy("_i"), False)


def part_sums(parts: DataFrame, by: Sequence[str], **columns: str) -> DataFrame:
    """`parts` (by, _part, ...) with, under each name, the sum of a column over the train's parts before."""
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    return parts.withColumns({name: F.coalesce(F.sum(c).over(ahead), F.lit(0)).cast("long") for name, c in columns.items()})
