"""Line deduplication through sharded minimal perfect hashes over line hashes.

1. Every document's distinct line hashes are counted: (hash, document) first, so that a line that is everywhere is summed
   up before it meets itself, then by hash, with the largest document that holds it.
2. Hashes found in enough documents (no other line can ever go) are dealt into shards. Each shard gets a minimal perfect
   hash: levels of bits, a key's place being the rank of its bit; fingerprints, counts and keepers stand in arrays by place.
3. Arrays of up to BLOCK_BYTES in all are broadcast, and documents probe them as they are read; no line moves. Larger
   ones stay where they are: each task deals its lines' hashes, packed, to the shards that own them, which probe and send
   the numbers of the lines that go back to their documents. The texts are read once for that, however many shards.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, WHITE, cut, deal, dealt, keys_of, mix, pack, pieces, rows_of, text_bytes, unpack

#: Keys of a shard; bytes of arrays that are broadcast; text bytes probed at once; packs of lines that one task probes.
SHARD_KEYS, BLOCK_BYTES, CHUNK, DEALT = 50_000, 64 << 20, 4 << 20, 2_000


class PerfectHash:
    """Maps n distinct 64-bit keys to 0..n-1, in about 3.5 bits a key and a rank for each 64 bits."""

    def __init__(self, keys: np.ndarray):
        words, self.base, self.size = [], [], []
        while len(keys):
            size = -(-max(64, 2 * len(keys)) // 64) * 64
            at = self._at(keys, len(self.size), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            self.base.append(sum(map(len, words)))
            self.size.append(size)
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            keys = keys[~alone]
        self.words = np.concatenate(words) if words else np.zeros(0, "<u8")
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.uint32)

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place; -1 or any place for a key that was not among the n."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (base, size) in enumerate(zip(self.base, self.size)):
            at = self._at(keys[left], level, size)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            got = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word[got]] & ((np.uint64(1) << bit[got]) - np.uint64(1)))
            out[left[got]] = self.rank[word[got]] + below
            left = left[~got]
        return out


class Shard:
    """The arrays of one shard."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.place = PerfectHash(keys)
        at = self.place(keys)
        self.prints, self.counts, self.keepers = np.empty_like(keys), np.empty(len(keys), np.uint32), np.empty(len(keys), np.int64)
        self.prints[at], self.counts[at], self.keepers[at] = keys, np.minimum(counts, 2**32 - 1), keepers

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the shard, and the keepers of those."""
        at = self.place(keys)
        hit = at >= 0
        hit[hit] = self.prints[at[hit]] == keys[hit]
        return hit, self.keepers[at[hit]]


def line_key(line: Column) -> Column:
    """ASCII white space stripped at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def line_counts(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(h, n, keeper): hash of each line key that enough documents hold, their number, the largest of them."""
    hashes = F.transform(F.split("_text", "\n", -1), lambda x: F.when(F.length(line_key(x)) >= min_chars, F.xxhash64(line_key(x))))
    held = rows.select("_id", F.explode(F.array_distinct(F.array_compact(hashes))).alias("h")).distinct()
    return held.groupBy("h").agg(F.count("*").alias("n"), F.max("_id").alias("keeper")).where(F.col("n") >= min_docs)


def _build(group: pa.Table) -> pa.Table:
    keys = group.column("h").to_numpy().view(np.uint64)
    shard = Shard(np.ascontiguousarray(keys), group.column("n").to_numpy(), group.column("keeper").to_numpy())
    return pa.table({"shard": group.column("shard").slice(0, 1), "arrays": pa.array([pickle.dumps(shard)], pa.binary())})


def _dropped(lines: list[str], doc: int, min_chars: int, index: dict[int, Shard], shards: int) -> list[int]:
    """Numbers of the lines that go."""
    keys = [x.strip(WHITE) for x in lines]
    long = [i for i, k in enumerate(keys) if len(k) >= min_chars]
    if not long:
        return []
    h = np.array([xxhash.xxh64_intdigest(keys[i].encode().lower(), 42) for i in long], np.uint64)
    of = h.view(np.int64) % shards
    out = []
    for s in np.unique(of).tolist():
        if s in index:
            some = np.flatnonzero(of == s)
            hit, keeper = index[s].probe(h[some])
            out += [long[i] for i in some[hit][keeper != doc].tolist()]
    return sorted(out)


def _lines(min_chars: int, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(shard, entries): hashes, document and line number of all lines long enough, packed for each shard; some million bytes of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", CHUNK):
            h, doc, number = [], [], []
            for d, text in enumerate(piece.column("_text").to_pylist()):
                for i, line in enumerate(text.split("\n")):
                    key = line.strip(WHITE)
                    if len(key) >= min_chars:
                        h.append(xxhash.xxh64_intdigest(key.encode().lower(), 42))
                        doc.append(d)
                        number.append(i)
            if h:
                yield from rows_of(_by_shard(np.array(h, np.uint64), np.array(doc), np.array(number, np.uint32), piece.column("_id").to_numpy(), piece.column("_th").to_numpy(), shards), ["shard", "entries"])

    return run


def _by_shard(h: np.ndarray, doc: np.ndarray, number: np.ndarray, ids: np.ndarray, th: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    shard = h.view(np.int64) % shards
    by = np.lexsort((doc, shard))
    for k in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1):
        used, own = np.unique(doc[k], return_inverse=True)
        yield int(shard[k[0]]), pack(h=h[k], line=number[k], doc=own.astype(np.uint32), ids=np.diff(ids[used], prepend=0), th=th[used].astype(np.uint32))


def _probe(parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(part, entries): the lines of a shard that go, by their documents' part."""

    def run(lines: pa.Table, arrays: pa.Table) -> pa.Table:
        rows: list[tuple[int, bytes]] = []
        if lines.num_rows and arrays.num_rows:
            shard: Shard = pickle.loads(arrays.column("arrays")[0].as_py())
            found = []
            for blob in lines.column("entries").to_pylist():
                x = unpack(blob)
                ids, th = np.cumsum(x["ids"])[x["doc"]], x["th"][x["doc"]]
                hit, keeper = shard.probe(x["h"])
                gone = np.flatnonzero(hit)[keeper != ids[hit]]
                found.append((ids[gone], th[gone], x["line"][gone]))
            rows = list(deal(*(np.concatenate(x) for x in zip(*found)), parts))
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "entries": pa.array([r[1] for r in rows], pa.binary())})

    return run


def _marks(group: pa.Table) -> pa.Table:
    """(_id, _th, gone): the numbers of the lines that go, for each document of a part."""
    i, t, line = (np.concatenate(x) for x in zip(*(dealt(b) for b in group.column("entries").to_pylist())))
    by = np.lexsort((line, t, i))
    i, t, line = i[by], t[by], line[by]
    new = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])]))
    gone = pa.ListArray.from_arrays(pa.array(np.append(new, len(i)).astype(np.int32)), pa.array(line.astype(np.int32)))
    return pa.table({"_id": pa.array(i[new], pa.int64()), "_th": pa.array(t[new].astype(np.int64), pa.int64()), "gone": gone})


def _clean(shared, shards: int, min_chars: int, kept: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole texts without the lines in `gone` and those that the shards in `shared` tell of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {s: pickle.loads(b) for s, b in shared.value}
        for piece in pieces(batches, "_text", CHUNK):
            texts, n, gone = [], [], []
            for i, t, g in zip(piece.column("_id").to_pylist(), piece.column("_text").to_pylist(), piece.column("gone").to_pylist()):
                lines = t.split("\n")
                drop = {*_dropped(lines, i, min_chars, index, shards), *(g or ())}
                texts.append("\n".join(x for k, x in enumerate(lines) if k not in drop))
                n.append(len(lines))
                gone.append(len(drop))
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*kept, "_kept", "_n_lines", "_n_dropped"])

    return run


def lines_dropped(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[str]]:
    """Every row of `docs` under private column names with _kept, _n_lines and _n_dropped, and the names to give back."""
    spark = docs.sparkSession
    ident, th, text = keys_of(docs, id_col, text_col)
    every = docs.select(ident.alias("_id"), th.alias("_th"), text.alias("_text"))
    found = cut(line_counts(every, min_chars, min_docs))
    shards = max(1, -(-found.count() // SHARD_KEYS))
    built = cut(found.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_build, "shard int, arrays binary"))
    kept = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, kept)), ident.alias("_id"), th.alias("_th"), text.alias("_text"))
    rest = [k for c, k in zip(docs.columns, kept) if c != text_col]
    if (built.agg(F.sum(F.length("arrays")).alias("size")).first()["size"] or 0) <= block_bytes:
        arrays = [(r["shard"], r["arrays"]) for r in built.collect()]  # at most block_bytes
        rows = rows.withColumn("gone", F.lit(None).cast("array<int>"))
    else:
        arrays, parts = [], max(16, shards)
        deals = max(1, -(-text_bytes(every, "_text") // (CHUNK * DEALT)))
        told = every.mapInArrow(_lines(min_chars, shards), "shard int, entries binary").withColumn("deal", F.pmod(F.xxhash64("entries"), F.lit(deals)).cast("int"))
        copies = built.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
        gone = told.groupBy("shard", "deal").cogroup(copies.groupBy("shard", "deal")).applyInArrow(_probe(parts), "part int, entries binary")
        rows = rows.join(cut(gone.groupBy("part").applyInArrow(_marks, "_id long, _th long, gone array<int>")), ["_id", "_th"], "left")
    schema = ", ".join([*(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(docs.columns, kept) if k in rest), "_kept string, _n_lines long, _n_dropped long"])
    return rows.mapInArrow(_clean(spark.sparkContext.broadcast(arrays), shards, min_chars, rest), schema), kept


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of `docs` with the text's repeated lines dropped, and n_lines, n_dropped (replaced if there were such).

    A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. Keys of at least `min_chars`
    code points that at least `min_docs` documents hold lose all their lines except in the document of the largest id.
    Texts are split at line feeds; a null or empty text is one empty line and stays as it is. Documents are told apart
    by id: rows that share an id count as one document, rows without an id too, which comes before all others.
    """
    out, kept = lines_dropped(docs, min_chars, min_docs, id_col, text_col, block_bytes)
    shown = [F.col("_kept" if c == text_col else k).alias(c) for c, k in zip(docs.columns, kept) if c not in ("n_lines", "n_dropped")]
    return out.select(*shown, F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"))
