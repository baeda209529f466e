"""Shared helpers: checkpointing, Arrow text columns as byte arrays, word spans, 64-bit hashes, packing."""

from __future__ import annotations

import itertools
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = " \t\n\x0b\x0c\r"
IS_WHITE = np.zeros(256, bool)
IS_WHITE[[ord(c) for c in WHITE]] = True

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A document without an id sorts before every other.
NULL_ID = -(2**63)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; if there is none, a temporary one on a single machine only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spikeframe-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, with no lineage before it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()["n"] or 0


def keys_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column, Column]:
    """Columns of a row's id as long (null: NULL_ID), 32 hash bits of its text, and the text (null: empty).

    Rows that share an id are told apart by their texts; rows that share both are one document. Where every row has an id
    of its own, the hash bits are 0.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    th = F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)) if has_copies(docs, id_col) else F.lit(0).cast("long")
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), th, text


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _th, _text) of every row, by keys_of()."""
    return docs.select(*(c.alias(n) for c, n in zip(keys_of(docs, id_col, text_col), ("_id", "_th", "_text"))))


def has_copies(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether any id, or none, stands in more than one row."""
    return not docs.groupBy(F.col(id_col).cast("long")).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def shown_id(col: str = "_id"):
    """The id as it was given."""
    return F.when(F.col(col) != F.lit(NULL_ID), F.col(col))


#: Bits of the map that only_marked() sends to every task: a fixed 4 MB.
MARKS = 1 << 25


def only_marked(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """The rows of (_id, _th, _text) that may be in `marked`, so that a join need not move the other texts.

    Tasks get a bitmap of fixed size; with ever more marked rows it lets ever more others pass, but loses none.
    """
    spark = rows.sparkSession
    bit = F.pmod(F.xxhash64("_id", "_th"), F.lit(MARKS)) + 1  # bucket 0 would hold the position 0 alone
    maps = marked.select(F.bitmap_bucket_number(bit).alias("n"), F.bitmap_bit_position(bit).alias("b")).groupBy("n").agg(F.bitmap_construct_agg("b").alias("map"))
    bits = np.zeros(MARKS // 8 + 4096, np.uint8)
    for r in maps.collect():  # at most MARKS / 32768 rows of 4 KB
        at = (r["n"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(r["map"], np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_bit").to_numpy()
            hit = np.flatnonzero((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if len(hit):
                yield batch.select(["_id", "_th", "_text"]).take(pa.array(hit))

    # bit positions count from the first bit of a bucket's map; bucket n covers (n - 1) * 32768 + 1 to n * 32768
    return rows.withColumn("_bit", (F.bitmap_bucket_number(bit) - 1) * 32768 + F.bitmap_bit_position(bit)).mapInArrow(run, "_id long, _th long, _text string")


def byte_column(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, one behind the other, and the rows' offsets in them; null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` text bytes at most; a longer text has a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + limit, "right")))
            pa.default_memory_pool().release_unused()  # else a worker keeps what its largest batch took
            yield batch.slice(lo, hi - lo)
            lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words [^ \\t-\\r]+, and the number of words before each row's text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    white = IS_WHITE[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
BLOCK = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    size = max(BLOCK, n)
    if size not in _powers:
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        made = np.cumprod(up), np.cumprod(down)
        if size > BLOCK:  # a rare, very long word: not kept
            return made
        _powers[size] = made
    return _powers[size]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each span's bytes, mixed; spans are sorted and disjoint. Memory: a block of bytes at a time."""
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        lo = starts[a]
        b = max(a + 1, int(np.searchsorted(ends, lo + BLOCK, "right")))
        hi = ends[b - 1]
        up, down = powers(hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
        out[a:b] = (sums[ends[a:b] - lo] - sums[starts[a:b] - lo]) * down[starts[a:b] - lo]
        a = b
    return mix(out)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every k consecutive symbols, mixed; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, base = h[:n].copy(), np.uint64(BASE)
    for i in range(1, k):
        out *= base
        out += h[i : i + n]
    return mix(out)


def pack(**arrays: np.ndarray) -> bytes:
    """Compressed integer arrays: the bytes of equal weight stand together, which leaves runs of zeros."""
    out = {}
    for k, a in arrays.items():
        a = np.ascontiguousarray(a)
        out[k] = (a.dtype.str, a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(out))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    out = {}
    for k, (kind, raw) in pickle.loads(zstandard.ZstdDecompressor().decompress(blob)).items():
        dtype = np.dtype(kind)
        planes = np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, -1)
        out[k] = np.ascontiguousarray(planes.T).view(dtype).reshape(-1)
    return out


def deal(ids: np.ndarray, th: np.ndarray, at: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, entries): places in documents, packed for each of `parts` parts of the documents; dealt() gives them back."""
    to = (mix(ids.view(np.uint64) ^ mix(th.astype(np.uint64))) % np.uint64(parts)).astype(np.int64)
    by = np.lexsort((at, th, ids, to))
    for k in np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if len(by) else ():
        new = np.ones(len(k), bool)
        new[1:] = (ids[k][1:] != ids[k][:-1]) | (th[k][1:] != th[k][:-1])
        own, some = k[new], np.diff(np.append(np.flatnonzero(new), len(k)))
        yield int(to[k[0]]), pack(ids=np.diff(ids[own], prepend=0), th=th[own].astype(np.uint32), n=some.astype(np.uint32), at=np.diff(at[k].astype(np.uint32), prepend=np.uint32(0)))


def dealt(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, th, places) of deal()."""
    x = unpack(blob)
    return np.repeat(np.cumsum(x["ids"]), x["n"]), np.repeat(x["th"], x["n"]), np.cumsum(x["at"], dtype=np.uint32)


def rows_of(rows: Iterator[tuple], names: list[str], together: int = 64) -> Iterator[pa.RecordBatch]:
    """Rows of whole numbers and, last, bytes, as batches of a few rows each."""
    kinds = [pa.int32()] * (len(names) - 1) + [pa.binary()]
    while some := list(itertools.islice(rows, together)):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], k) for i, k in enumerate(kinds)], names)


def carried(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The same rows under column names that no operator uses inside, and these names, in the order of the columns."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names))), names


def restored(rows: DataFrame, docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns of `docs` from rows that hold them under `names`."""
    return rows.select(*(F.col(c).alias(name) for c, name in zip(names, docs.columns)))
