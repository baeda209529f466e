"""Mixing sources to target weights by Pfair scheduling. DataFrame functions only.

Of M slots, a source with m blocks has the weight m / M. Its block j may not run before slot floor(j M / m) and must
have run by slot ceil((j + 1) M / m). In each slot, the block of the earliest deadline among those released runs; since
the weights sum to 1, every block meets its deadline, and at any moment each source is less than one block from its share.

The number of slots is a parameter; a source's documents are spread evenly over its blocks. A document's rank within its
source comes from counts of (source, hash bucket) and a rank within the bucket, so no source needs a task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType
from pyspark.sql.window import Window

from .common import cut, has_copies

#: The plan (one row a block, under 100 bytes each) is broadcast up to so many rows.
PLAN_ROWS = 100_000


def source_targets(docs: DataFrame, weights: DataFrame | None, source_col: str, most: float | None) -> DataFrame:
    """(_src, n, k): documents of each source and how many of them the mix takes."""
    n = docs.groupBy("_src").agg(F.count("*").alias("n"))
    if weights is None and most is None:
        return n.select("_src", "n", F.col("n").alias("k"))
    if weights is None:
        bound = n.agg(F.floor(F.percentile("n", F.lit(0.5)) * most).alias("bound"))
        return n.join(F.broadcast(bound)).select("_src", "n", F.least("n", F.greatest("bound", F.lit(1))).alias("k"))  # bound: one row
    w = weights.where("weight > 0").select(_source(source_col).alias("_src"), F.col("weight").cast("double").alias("w"))
    both = n.join(w, "_src")
    reach = both.agg(F.min(F.col("n") / F.col("w")).alias("reach"))
    k = F.least(F.col("n"), F.floor(F.col("w") * F.col("reach") + 1e-9))
    return both.join(F.broadcast(reach)).select("_src", "n", k.alias("k")).where("k > 0")  # reach: one row


def _source(col: str):
    """Told apart from null, which is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """(_src, k, m, j, slot, start): each block's slot, and the number of documents in the slots before it."""
    size = targets.agg(F.ceil(F.sum("k") / F.lit(slots)).alias("size"))
    blocks = targets.join(F.broadcast(size)).select("_src", F.col("k").cast("long").alias("k"), F.ceil(F.col("k") / F.col("size")).alias("m"))  # size: one row
    row = blocks.agg(F.sort_array(F.collect_list(F.struct("_src", "k", "m"))).alias("s"), F.sum("m").alias("total"))
    ready = """array_min(transform(acc.done, (d, i) -> if(d < s[i].m and (d * total) div s[i].m <= t,
        struct(((d + 1) * total + s[i].m - 1) div s[i].m as deadline, i as i, d as j), null)))"""
    run = f"""aggregate(sequence(0L, total - 1),
        named_struct('done', transform(s, x -> 0L), 'out', cast(array() as array<struct<deadline:bigint,i:int,j:bigint>>)),
        (acc, t) -> transform(array({ready}), p -> named_struct(
            'done', transform(acc.done, (d, i) -> if(i = p.i, d + 1, d)), 'out', array_append(acc.out, p)))[0],
        acc -> acc.out)"""
    placed = row.where("total > 0").select("s", F.expr(run).alias("out")).select("s", F.posexplode("out").alias("slot", "p"))
    named = placed.select(F.expr("s[p.i]._src").alias("_src"), F.expr("s[p.i].k").alias("k"), F.expr("s[p.i].m").alias("m"), F.col("p.j").alias("j"), F.col("slot").cast("long").alias("slot"))
    begin = "((j * k + m - 1) div m)"
    sized = named.withColumn("begin", F.expr(begin)).withColumn("size", F.expr("((j + 1) * k + m - 1) div m") - F.col("begin"))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # one row a slot
    return sized.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long"))


def _hashable(kind: DataType) -> bool:
    """Whether values of the type have a hash: no map in them."""
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType)


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, slots: int = 2000, most: float | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents of the mix, all columns of `docs` and block, slot, position (replaced if there were such).

    `weights` has `source_col` and weight; as many documents are taken as allow every source its share of the whole.
    Without it, sources are weighted by size and every document is placed; only if the caller gives `most`, no source
    takes more than that many times the median size. Within a source, the
    order is that of the ids' MD5. `position` counts from 0 over the whole mix; sorting by it gives the interleaved order.
    Rows without a source form one source; rows that share an id are rows of their own, in the order
    of the hashes of their columns, but for those with maps (only then are rows hashed); columns may be of any type.
    An empty table gives an empty result. Tables of sources, buckets and slots are held small: their size depends on the
    number of sources and on `slots`, not on the number of documents.
    """
    kept = [c for c in docs.columns if c not in ("block", "slot", "position")]
    rows = docs.select(F.struct(*kept).alias("_row"), _source(source_col).alias("_src"), F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit("")).alias("_o"))
    rows = rows.withColumn("_b", F.substring("_o", 1, 3))
    counts = docs.select(_source(source_col).alias("_src"), F.substring(F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit("")), 1, 3).alias("_b")).groupBy("_src", "_b").agg(F.count("*").alias("c"))
    before = Window.partitionBy("_src").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_src", "_b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    targets = source_targets(docs.select(_source(source_col).alias("_src")), weights, source_col, most)
    plan = cut(schedule(targets, slots))
    small = (lambda df: F.broadcast(df)) if plan.count() <= PLAN_ROWS else (lambda df: df)
    share = plan.groupBy("_src").agg(F.first("k").alias("k"), F.first("m").alias("m"))
    hashed = [F.col(f"_row.`{c}`") for c in kept if _hashable(docs.schema[c].dataType)]
    ties = [F.xxhash64(*hashed)] if hashed and has_copies(docs, id_col) else []
    within = Window.partitionBy("_src", "_b").orderBy("_o", *ties)
    ranked = rows.withColumn("_r", F.row_number().over(within) - 1).join(offsets, ["_src", "_b"]).withColumn("_r", F.col("_r") + F.col("offset"))
    taken = ranked.join(small(share), "_src").where("_r < k").withColumn("j", F.expr("(_r * m) div k"))
    placed = taken.join(small(plan.select("_src", "j", "slot", "begin", "start")), ["_src", "j"])
    return placed.select("_row.*", F.col("j").alias("block"), "slot", (F.col("start") + F.col("_r") - F.col("begin")).cast("long").alias("position"))
