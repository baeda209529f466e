"""Exact top-k inner products by norm-bucketed retrieval.

1. Candidates are grouped by length over the whole table: classes by quantiles of the length, each cut into blocks. Every
   query gets a first threshold, its k-th best product with the longest candidates (a bounded number, broadcast), and is sent
   only to the blocks whose longest vector can reach it.
2. A pair of a query block and a candidate block is one task's work. There, candidates are cut into buckets by length,
   longest first. A query's threshold so far and the bucket's longest vector give the cosine that a candidate must reach in
   this bucket. If it is above 1, the query is done with the bucket and all after it. If it is low, candidates are pruned
   by length alone; if it is high, by the coordinates in which the query is largest, with the Cauchy-Schwarz bound for the
   rest. What remains is verified by whole products.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

BUCKET, FOCUS, HIGH = 1024, 16, 0.5
QUERY_BLOCK, CANDIDATE_BLOCK, LEAST_BLOCKS = 20_000, 50_000, 16
#: Classes of length; longest candidates that give the first thresholds.
CLASSES, SEEDS = 256, 2_048
#: Numbers in a block of products.
PRODUCTS = 4_000_000
#: A length from which squares may overflow.
LONGEST = 1e150


def quantized(col: pa.ChunkedArray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of the vectors without nulls and non-finite components, padded with zeros; rows that they are of."""
    lists = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    size = np.array([len(x) if x is not None else -1 for x in lists.to_pylist()], np.int64) if lists.null_count else np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().cast(pa.float64())
    values = np.floor(flat.fill_null(np.nan).to_numpy(zero_copy_only=False) * scale)
    rows = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    bad = size < 0
    bad[rows[~np.isfinite(values)]] = True
    width = int(max(size.max(initial=0), 1))
    out = np.zeros((len(size), width))
    first = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    out[rows, np.arange(len(values)) - first[rows]] = values
    return out[~bad], np.flatnonzero(~bad)


def small(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether no product of a row of one and a row of the other can reach 2**53."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], b.shape[0]) < 2**53


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of whole numbers: in doubles if no sum can reach 2**53, else in Python's integers, held within a long."""
    if small(a, b):
        return (a @ b).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a).dot(whole(b)), -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each query."""

    def __init__(self, n: int, k: int):
        self.k, self.query = k, np.zeros(0, np.int64)
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(n, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        q, s, i = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ident])
        by = np.lexsort((i, ~s, q))  # ~s falls as s rises, at every value
        q, s, i = q[by], s[by], i[by]
        new = np.ones(len(q), bool)
        new[1:] = q[1:] != q[:-1]
        place = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
        keep = place < self.k
        self.query, self.score, self.id = q[keep], s[keep], i[keep]
        last = place == self.k - 1
        self.least[q[last]] = s[last]


def _lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.minimum(np.linalg.norm(x, axis=1), LONGEST)


def _high_bounds(q: np.ndarray, vec: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bounds of the products of each query with each vector: FOCUS coordinates of the query exactly, the rest by lengths."""
    out = np.empty((len(q), len(vec)))
    squares, total = vec**2, length**2
    for i, x in enumerate(q):
        focus = np.argsort(-np.abs(x), kind="stable")[:FOCUS]
        rest = np.sqrt(np.maximum(total - squares[:, focus].sum(axis=1), 0))
        out[i] = vec[:, focus] @ x[focus] + math.sqrt(max(float(x @ x - x[focus] @ x[focus]), 0.0)) * rest
    return out


def _search(k: int, scale: float) -> Callable[[pa.Table], pa.Table]:
    """(query_id, vec_id, score, verified): each query's best of a block; `verified`, products computed for it, stands in one row of each query."""

    def run(group: pa.Table) -> pa.Table:
        asked = group.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        queries, candidates = group.filter(pa.array(asked)), group.filter(pa.array(~asked))
        q, rows = quantized(queries.column("vec"), scale)
        q_id, seed = queries.column("id").to_numpy()[rows], queries.column("least").to_numpy(zero_copy_only=False)[rows]
        p, rows = quantized(candidates.column("vec"), scale)
        p_id = candidates.column("id").to_numpy()[rows]
        width = max(q.shape[1], p.shape[1])
        q, p = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, p))
        p_len, q_len = _lengths(p), _lengths(q)
        by = np.argsort(-p_len, kind="stable")
        p, p_id, p_len = p[by], p_id[by], p_len[by]
        best, slack, verified = Best(len(q), k), 1 + 1e-9, np.zeros(len(q), np.int64)
        best.least[:] = seed
        for lo in range(0, len(p), BUCKET):
            vec, ident, length = p[lo : lo + BUCKET], p_id[lo : lo + BUCKET], p_len[lo : lo + BUCKET]
            reach = q_len * length[0] * slack
            # beyond what doubles can square, nothing is pruned
            prune = length[0] < LONGEST
            live = np.flatnonzero((reach >= best.least) | (q_len == LONGEST) | (not prune))
            for some in np.array_split(live, max(1, math.ceil(len(live) * len(vec) / PRODUCTS))):
                if not len(some):
                    continue
                least = best.least[some]
                cosine = np.where(reach[some] > 0, least / np.maximum(reach[some], 1e-300), -np.inf)
                bound = np.outer(q_len[some], length) * slack
                bound[(q_len[some] == LONGEST) | (not prune)] = np.inf
                high = (cosine >= HIGH) & (q_len[some] < LONGEST) & prune
                if high.any():
                    bound[high] = _high_bounds(q[some[high]], vec, length) + 1e-6 * reach[some[high]][:, None]
                may = (bound >= least[:, None]) & (ident[None, :] != q_id[some][:, None])
                if may.sum() > may.size // 8:
                    score = exact_product(q[some], vec.T)
                    verified[some] += len(vec)
                    at, which = np.nonzero(may & (score >= least[:, None]))
                    score = score[at, which]
                else:
                    verified[some] += may.sum(axis=1)
                    at, which = np.nonzero(may)
                    if small(q[some], vec.T):
                        score = np.einsum("ij,ij->i", q[some][at], vec[which]).astype(np.int64)
                    else:
                        score = np.array([exact_product(q[some[a]][None], vec[w][:, None])[0, 0] for a, w in zip(at, which)], np.int64)
                best.add(some[at], score, ident[which])
        none = np.flatnonzero(~np.isin(np.arange(len(q)), best.query))  # queries that found nothing here, but whose products count
        first = np.concatenate([np.ones(min(len(best.query), 1), bool), best.query[1:] != best.query[:-1]])
        return pa.table({
            "query_id": np.concatenate([q_id[best.query], q_id[none]]), "vec_id": pa.array([*best.id.tolist(), *[None] * len(none)], pa.int64()), "score": pa.array([*best.score.tolist(), *[None] * len(none)], pa.int64()),
            "verified": np.concatenate([np.where(first, verified[best.query], 0), verified[none]]),
        })

    return run


def _first_thresholds(seeds, k: int, scale: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Queries with `least`, their k-th best product with the seeds that are not their own id (-inf: fewer), and their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p_id, p = seeds.value
        for batch in batches:
            q, rows = quantized(batch.column("vec"), scale)
            q_id = batch.column("id").to_numpy()[rows]
            width = max(q.shape[1], p.shape[1])
            x, y = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (q, p))
            best = Best(len(x), k)
            for lo in range(0, len(x), 1024):
                score = exact_product(x[lo : lo + 1024], y.T)
                at, which = np.nonzero(p_id[None, :] != q_id[lo : lo + 1024, None])
                best.add(at + lo, score[at, which], p_id[which])
            yield pa.RecordBatch.from_arrays([pa.array(q_id, pa.int64()), batch.column("vec").take(pa.array(rows)), pa.array(best.least), pa.array(_lengths(x))], ["id", "vec", "least", "length"])

    return run


def searched(vectors: DataFrame, queries: DataFrame, k: int, scale: float, id_col: str, vec_col: str) -> DataFrame:
    """(query_id, vec_id, score, verified) of all pairs of blocks: every query's k best are among its rows."""
    spark = vectors.sparkSession
    valid = lambda df: df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    # beyond what a long holds, a little more than the component
    whole = F.transform("vec", lambda x: F.when(F.abs(x * scale) < 2.0**62, F.abs(F.floor(x * scale)).cast("double")).otherwise(F.least(F.abs(x * scale) * (1 + 1e-9), F.lit(LONGEST))))
    sized = F.least(F.sqrt(F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x)), F.lit(LONGEST))
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    p = cut(valid(vectors).where(finite).withColumn("length", sized))
    q = valid(queries).where(finite).dropDuplicates(["id"])
    longest = p.orderBy(F.desc("length"), "id").limit(SEEDS).select("id", "vec").toArrow()
    seeds, rows = quantized(longest.column("vec"), scale) if longest.num_rows else (np.zeros((0, 1)), np.zeros(0, np.int64))
    shared = spark.sparkContext.broadcast((longest.column("id").to_numpy()[rows], seeds))  # at most SEEDS vectors
    q = cut(q.mapInArrow(_first_thresholds(shared, k, scale), "id long, vec array<double>, least double, length double"))
    n = p.count()
    cuts = sorted(set(p.agg(F.percentile_approx("length", [i / CLASSES for i in range(1, CLASSES)], 10_000).alias("c")).first()["c"] or []))
    kind = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)).cast("array<double>"), lambda c: c <= F.col("length"))) if cuts else F.lit(0)
    p = p.withColumn("kind", kind)
    # a class of many rows, such as copies of one vector, has as many blocks as it needs; one of few rows, one
    per_block = max(1, min(CANDIDATE_BLOCK, -(-n // LEAST_BLOCKS)))
    classes = p.groupBy("kind").agg(F.count("*").alias("n"), F.max("length").alias("top")).orderBy("kind").collect()  # at most CLASSES rows
    blocks, first, filled = [], {}, 0
    for r in classes:
        if not blocks or filled + r["n"] > per_block:
            blocks += [r["top"]] * max(1, -(-r["n"] // per_block))
            first[r["kind"]] = (len(blocks) - max(1, -(-r["n"] // per_block)), max(1, -(-r["n"] // per_block)))
            filled = r["n"]
        else:  # short classes of neighbouring lengths share a block
            first[r["kind"]] = (len(blocks) - 1, 1)
            blocks[-1], filled = max(blocks[-1], r["top"]), filled + r["n"]
    # Blocks stand in the order of their longest vectors, so a query asks for all blocks from one on. `steps` are blocks of one bound.
    steps = [row for row, top in enumerate(blocks) if row == 0 or top != blocks[row - 1]]  # at most CLASSES
    step_of = {kind: sum(row <= at for row in steps) - 1 for kind, (at, _) in first.items()}
    tops = F.array(*(F.lit(blocks[row]) for row in steps)).cast("array<double>")
    can = lambda top: (F.col("length") * top * (1 + 1e-9) >= F.col("least")) | (F.col("length") >= LONGEST) | (top >= LONGEST)
    q = q.withColumn("step", F.size(F.filter(tops, lambda top: ~can(top)))).where(F.col("step") < len(steps))
    asking = q.groupBy("step").agg(F.count("*").alias("n")).orderBy("step").collect()  # at most CLASSES rows
    # Columns of queries in the order of their first blocks; those of few queries share one. A block goes to the columns that ask for it.
    cols, dealt, filled = [], {}, 0
    for r in asking:
        if not cols or filled + r["n"] > QUERY_BLOCK:
            some = max(1, -(-r["n"] // QUERY_BLOCK))
            dealt[r["step"]] = (len(cols), some)
            cols += [r["step"]] * some
            filled = r["n"] if some == 1 else QUERY_BLOCK
        else:
            dealt[r["step"]] = (len(cols) - 1, 1)
            filled += r["n"]
    place = spark.createDataFrame([(c, a, b, sum(step <= step_of[c] for step in cols)) for c, (a, b) in first.items()], "kind int, first int, some int, asked_by int")
    row = (F.col("first") + F.pmod(F.monotonically_increasing_id(), F.col("some"))).cast("int")
    wanted = p.join(F.broadcast(place), "kind").where("asked_by > 0")  # place: at most CLASSES rows
    cand = wanted.select(row.alias("row"), F.explode(F.sequence(F.lit(0), F.col("asked_by") - 1)).alias("col"), F.lit(False).alias("asked"), "id", "vec", F.lit(0.0).alias("least"))
    columns = spark.createDataFrame([(step, steps[step], a, b) for step, (a, b) in dealt.items()], "step int, from_row int, first int, some int")
    col = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("some"))).cast("int")
    asks = q.join(F.broadcast(columns), "step")  # columns: at most CLASSES rows
    ask = asks.select(F.explode(F.sequence(F.col("from_row"), F.lit(len(blocks) - 1))).alias("row"), col.alias("col"), F.lit(True).alias("asked"), "id", "vec", "least")
    return cand.union(ask).groupBy("row", "col").applyInArrow(_search(k, scale), "query_id long, vec_id long, score long, verified long")


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of `vectors` with the highest inner product, for each row of `queries`.

    Components count as floor(scale * x), x as double; products of whole numbers are exact. Ties go to the smaller id; a
    query's own id is no candidate of it, in any row. Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part; shorter vectors count as padded with zeros. Repeated candidate rows count as often as
    they occur; repeated query rows once. Scores beyond a long are held at its ends.
    """
    found = searched(vectors, queries, k, scale, id_col, vec_col).where("vec_id IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
