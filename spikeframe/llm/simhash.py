"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some word is within r bits of both. Every distinct fingerprint
emits all words within r bits, they meet on equal words, and colliding pairs are verified. The words are dealt by their
leading bits: a fingerprint goes once to each range of words that its ball reaches, with the flips it has left, and the
rest of its ball is written out there, range by range, splitting on further bits while a range holds too many words.
All owners of one word are linked with one another, so each word links its owners to the first of them, which gives the
same components with as many links as owners.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, pieces
from .components import connected_components, lowest_of_component

#: Shingles whose bits are counted at once; ball words handled at once, and aimed at for each range.
BLOCK, MOST, AIM = 1 << 15, 3_000_000, 2_000_000


def fingerprint(text: bytes, shingle: int, tables: int = 1) -> list[int]:
    """Of each table, bit i is 1 if set in over half of the shingles' hashes; no words: 0.

    The first table's hash is XXH64 (seed 42), the others' are mixed from it.
    """
    words = text.lower().split()
    if not words:
        return [0] * tables
    joined = b" ".join(words)
    size = np.cumsum([len(w) + 1 for w in words])
    k = min(shingle, len(words))
    ends = (size[k - 1 :] - 1).tolist()
    starts = [0, *size[: len(size) - k].tolist()]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros((tables, 64), np.int64)
    for lo in range(0, len(starts), BLOCK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[lo : lo + BLOCK], ends[lo : lo + BLOCK])], "<u8")
        for k in range(tables):
            own = mix(h + np.uint64(k)) if k else h
            ones[k] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [sum(1 << i for i in np.flatnonzero(2 * x > len(starts)).tolist()) for x in ones]


def _fingerprints(shingle: int, tables: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", 8 << 20):
            fp = np.array([fingerprint(t.encode(), shingle, tables) for t in piece.column("_text").to_pylist()], np.uint64).view(np.int64)
            more = pa.ListArray.from_arrays(np.arange(len(fp) + 1, dtype=np.int32) * (tables - 1), pa.array(fp[:, 1:].ravel()))
            yield pa.RecordBatch.from_arrays([piece.column("_id"), pa.array(np.ascontiguousarray(fp[:, 0])), more], ["_id", "fp", "more"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", tables: int = 1) -> DataFrame:
    """(_id, fp, more): the 64-bit fingerprint of every row's text, as a signed long, and those of further tables."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    return rows.mapInArrow(_fingerprints(shingle, tables), "_id long, fp long, more array<long>")


def _split(fp: np.ndarray, left: np.ndarray, bit: int, value: int) -> tuple[np.ndarray, np.ndarray]:
    """Which balls reach words whose `bit` is `value`, and the flips that they have left there."""
    left = left - (((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) != value)
    reach = left >= 0
    return reach, left[reach]


def _ranges(bits: int, radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each range of words, given by the leading bits, that a ball reaches."""
    flips = [(sum(1 << i for i in c), len(c)) for k in range(min(bits, radius) + 1) for c in itertools.combinations(range(bits), k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, table = batch.column("fp").to_numpy(), batch.column("table")
            head = (fp.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            for mask, k in flips:
                yield pa.RecordBatch.from_arrays([table, pa.array((head ^ mask).astype(np.int32)), pa.array(fp), pa.array(np.full(len(fp), radius - k, np.int8))], ["table", "head", "fp", "left"])

    return run


def ball_size(free: int, left: int) -> int:
    return sum(math.comb(free, k) for k in range(left + 1))


def _leaf(fp: np.ndarray, left: np.ndarray, owner: np.ndarray, free: int) -> np.ndarray:
    """Pairs of owners (first, other) of equal words; the words' higher bits are the same for all here."""
    low = fp & np.uint64((1 << free) - 1 if free < 64 else 2**64 - 1)
    words, owners = [], []
    for k in np.unique(left).tolist():
        masks = np.array([sum(1 << i for i in c) for j in range(k + 1) for c in itertools.combinations(range(free), j)], np.uint64)
        some = left == k
        words.append((low[some][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(owner[some], len(masks)))
    word, own = np.concatenate(words), np.concatenate(owners)
    by = np.argsort(word)
    word = word[by]
    equal = np.flatnonzero(word[1:] == word[:-1])
    if not len(equal):
        return np.zeros((0, 2), np.int64)
    member = np.zeros(len(word), bool)
    member[equal] = member[equal + 1] = True
    word, own = word[member], own[by[member]]
    new = np.ones(len(word), bool)
    new[1:] = word[1:] != word[:-1]
    run = np.cumsum(new) - 1
    first = np.minimum.reduceat(own, np.flatnonzero(new))[run]
    code = np.unique(first[first != own] << np.int64(32) | own[first != own])
    return np.stack([code >> np.int64(32), code & np.int64(0xFFFFFFFF)], axis=1)


def _forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """A spanning forest of the pairs."""
    up, kept = list(range(n)), []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs.tolist():
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append((a, b))
    return np.array(kept, np.int64).reshape(-1, 2)


def _links(bits: int, most: int, limit: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        fp, owner = np.unique(group.column("fp").to_numpy().view(np.uint64), return_inverse=True)
        left = group.column("left").to_numpy().astype(np.int64)
        found = [np.zeros((0, 2), np.int64)]

        def expand(own: np.ndarray, left: np.ndarray, free: int) -> None:
            if len(own) < 2:
                return
            size = sum(ball_size(free, k) * int((left == k).sum()) for k in np.unique(left).tolist())
            if size <= most or not free:
                found.append(_leaf(fp[own], left, own, free))
                return
            for value in (0, 1):
                reach, rest = _split(fp[own], left, free - 1, value)
                expand(own[reach], rest, free - 1)

        expand(owner.astype(np.int64), left, 64 - bits)
        pairs = _forest(np.concatenate(found), len(fp))
        a, b = fp[pairs[:, 0]], fp[pairs[:, 1]]
        near = np.bitwise_count(a ^ b) <= limit
        table = pa.array(np.full(int(near.sum()), group.column("table")[0].as_py(), np.int32))
        return pa.table({"table": table, "a": pa.array(a[near].view(np.int64)), "b": pa.array(b[near].view(np.int64))})

    return run


def near_fingerprints(distinct: DataFrame, differing_bits: int = 4) -> DataFrame:
    """(table, a, b): verified links between fingerprints of a table, enough of them to connect all within reach.

    `distinct` has a column fp (repeats do no harm) and may have table, an int. Only even `differing_bits` have a half
    to meet in.
    """
    if differing_bits < 0 or differing_bits % 2:
        raise ValueError("differing_bits must be even")
    if "table" not in distinct.columns:
        distinct = distinct.withColumn("table", F.lit(0))
    radius = differing_bits // 2
    words = distinct.count() * ball_size(64, radius)
    bits = min(20, max(6, math.ceil(math.log2(max(1, words / AIM)))))
    reached = distinct.select("table", "fp").mapInArrow(_ranges(bits, radius), "table int, head int, fp long, left tinyint")
    return reached.groupBy("table", "head").applyInArrow(_links(bits, MOST, differing_bits), "table int, a long, b long")


def simhash_components(docs: DataFrame, shingle: int = 4, differing_bits: int = 4, id_col: str = "doc_id", text_col: str = "text", tables: int = 1) -> DataFrame:
    """(`id_col`, fp, component_id) of every row: fingerprint as a signed long, smallest id reachable over links.

    With more than one table, texts are linked if the fingerprints of any table are near; fp is the first table's.
    Texts are split at ASCII white space and lower-cased in A-Z; texts of fewer words than a shingle are one shingle,
    texts without words, null ones too, have fingerprint 0 and are linked like any others. A null id takes part but
    names a component only if the component has no other (then it is null). Repeated rows each get a row.
    """
    fps = cut(fingerprints(docs, shingle, id_col, text_col, tables).withColumn("node", F.col("fp") if tables == 1 else F.xxhash64("fp", "more")))
    distinct = cut(fps.groupBy("node").agg(F.min("_id").alias("low"), F.first("fp").alias("fp"), F.first("more").alias("more")))
    if tables == 1:
        links = near_fingerprints(distinct, differing_bits)
    else:  # one graph of texts and of all tables' fingerprints: those that are linked, or that several texts have
        key = lambda fp: F.xxhash64("table", fp)
        every = distinct.select("node", F.posexplode(F.concat(F.array("fp"), "more")).alias("table", "fp"))
        near = cut(near_fingerprints(every, differing_bits)).select(key("a").alias("a"), key("b").alias("b"))
        own = every.select("node", key("fp").alias("key"))
        used = own.select("key").union(near.select("a")).union(near.select("b")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        links = near.union(own.join(used, "key").select("node", "key"))
    root = connected_components(links)
    of_node = lowest_of_component(distinct.select("node", "low"), root).withColumnRenamed("low", "component_id")
    return fps.select("_id", "fp", "node").join(of_node, "node").select(F.col("_id").alias(id_col), "fp", "component_id")
