"""Lloyd's rounds over any number of points: each round is one job of partial sums, and only the centres travel.

Sums are of whole numbers, coordinates in steps of 2**-24, so that a round gives the same centres however rows are dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered_sum
from ..storage import checkpointed
from .parts import cut_trains, same

STEPS = float(1 << 24)
#: Groups whose centres may be broadcast; with more, points meet them in a join.
MOST_GROUPS = 1_000


def squared_distance(a: Column, b: Column) -> Column:
    return ordered_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def nearest_centre(points: DataFrame, centres: DataFrame, by: Sequence[str]) -> DataFrame:
    """`points` (by, features, ...) with label: the place of the nearest of the group's centres (by, centres); ties to the lowest."""
    small = F.broadcast(centres) if not by or centres.count() <= MOST_GROUPS else centres
    far = F.transform("centres", lambda c: squared_distance(F.col("features"), c))
    met = same(points, small, by).withColumn("_d", far)
    return met.withColumn("label", (F.array_position("_d", F.array_min("_d")) - 1).cast("long")).drop("_d", "centres")


def recomputed_centres(labelled: DataFrame, k: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, centres): the mean of each label's features; a label without points is at zero. `k`: (by, k, width)."""
    steps = labelled.select(*by, "label", F.posexplode("features").alias("pos", "x")).withColumn("x", F.floor(F.col("x") * STEPS + 0.5).cast("decimal(20,0)"))
    mean = F.sum("x").cast("double") / F.count("*") / STEPS
    means = steps.groupBy(*by, "label", "pos").agg(mean.alias("m"))
    centre = F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda v: v["m"])  # one value a coordinate
    found = means.groupBy(*by, "label").agg(centre.alias("c")).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("found"))  # one entry a centre
    zero = F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.lit(0.0))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: F.coalesce(F.try_element_at("found", i), zero))
    return same(k, found, by).select(*by, every.alias("centres"))


def kmeans(points: DataFrame, max_clusters: int, by: Sequence[str] = ("unit",), order: Sequence[str] = ("idx",), features: str = "features", rounds: int = 30, part_rows: int | None = None) -> DataFrame:
    """`points` with label: clusters after `rounds` rounds, or fewer if the centres stand still.

    Of n points in their order, k = min(max_clusters, n) evenly spaced ones are the first centres.
    """
    rows = points.select(F.struct(*points.columns).alias("_row"), *by, *(c for c in order if c not in by), F.transform(features, lambda x: x.cast("double")).alias("features"))
    placed = checkpointed(cut_trains(rows, by, order, part_rows=part_rows).rows.select("_row", *by, "_i", "features"))
    k = placed.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.size("features")).alias("width")).withColumn("k", F.greatest(F.lit(1), F.least(F.lit(max_clusters), F.col("n"))).cast("long"))
    k = checkpointed(k)
    first = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda i: F.struct(i.alias("c"), F.least(i * F.floor(F.col("n") / F.col("k")), F.col("n") - 1).alias("_i"))))
    at = k.select(*by, first.alias("f")).select(*by, "f.c", "f._i")
    begin = same(placed.select(*by, "_i", "features"), at, [*by, "_i"]).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("c", "features"))).alias("_c"))  # one a centre
    centres = checkpointed(begin.select(*by, F.transform("_c", lambda c: c["features"]).alias("centres")))
    for _ in range(rounds - 1):
        new = checkpointed(recomputed_centres(nearest_centre(placed, centres, by), k, by))
        moved = not same(new.withColumnRenamed("centres", "_new"), centres, by).where("_new <> centres").isEmpty()
        centres = new
        if not moved:
            break
    return nearest_centre(placed, centres, by).select("_row.*", "label")
