"""Connected components by alternating large-star and small-star steps over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _lowest(pairs: DataFrame) -> DataFrame:
    """For each u of pairs (u, v): low, the smallest of u and its v."""
    return cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("low")))


#: Tasks that a component's nodes are dealt to.
SALT = 32


def lowest_of_component(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, low) of every row of `nodes` (node, low): the smallest `low` of its component; `roots` has (node, root) of linked nodes.

    A component with a third of all nodes meets its one smallest value in SALT tasks, which get a copy of it each.
    """
    named = nodes.join(roots, "node", "left")
    linked = named.where("root IS NOT NULL").withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALT)))
    least = linked.groupBy("root").agg(F.min("low").alias("_least")).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return linked.join(least, ["root", "_salt"]).select("node", F.col("_least").alias("low")).union(named.where("root IS NULL").select("node", "low"))


def _signature(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in `links` (a long, b long); root is the smallest node of its component.

    Links may be repeated or join a node to itself. Without links the result is empty. Every step cuts its lineage.
    """
    pairs = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # large star: each node passes its neighbours above it to the smallest neighbour
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(both.join(_lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        # small star: each node passes its neighbours below it, and itself, to the smallest of them
        low = _lowest(large)
        both_ends = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
        new = cut(both_ends.where("u <> v").distinct())
        before, pairs = _signature(pairs), new
        if _signature(pairs) == before:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
