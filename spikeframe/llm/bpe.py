"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves hold, for each position, rank * width + position of the pair that starts there; the root is the smallest
value and so yields the leftmost pair of lowest rank. A merge changes at most three leaves, whose paths to the root are
updated; it goes on until no pair can be merged. Short pieces of a batch are merged side by side, each in its own tree,
a level of all trees being one array; long pieces have a tree of their own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces

#: Fixed: how byte-level BPE splits text before merging. White space is Unicode's White_Space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = np.int64(2**62)
#: Pieces of up to this many bytes share trees; a worker's cache holds this many pieces of up to 64 bytes.
SHORT, CACHE = 64, 200_000
#: Text bytes encoded at once.
CHUNK = 2 << 20


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Merge table, token bytes and special tokens of a byte-level BPE file; picklable, of the file's size."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], special: dict[str, int]):
        of = {c: b for b, c in byte_symbols().items()}
        self.start = np.array([vocab[c] for _, c in sorted(byte_symbols().items())], np.int64)
        pair = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.int64)
        into = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(pair, kind="stable")
        self.pair, self.rank, self.into = pair[order], order.astype(np.int64), into[order]
        self.bytes = {i: t.encode() for t, i in special.items()}
        self.bytes |= {i: bytes(of[c] for c in t) for t, i in vocab.items() if i not in self.bytes and all(c in of for c in t)}
        self.special = special

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        return cls(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec.get("added_tokens", [])})

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE: no merge) and what it merges into."""
        key = (left << np.int64(32)) | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.rank[at], NONE), self.into[at]


def merge_many(words: list[bytes], voc: Vocabulary) -> list[bytes]:
    """Token ids of each piece as little-endian uint32; the pieces have at most SHORT bytes."""
    n, width = len(words), 2
    longest = max(map(len, words))
    while width < longest:
        width *= 2
    size = np.array([len(w) for w in words])
    sym = np.full((n, width + 1), -1, np.int64)
    flat = np.frombuffer(b"".join(words), np.uint8)
    inside = np.arange(width + 1)[None, :] < size[:, None]
    sym[inside] = voc.start[flat]
    nxt = np.tile(np.arange(1, width + 2), (n, 1))
    prv = np.tile(np.arange(-1, width), (n, 1))
    # levels[0]: leaves; levels[-1]: roots
    rank, _ = voc.lookup(sym[:, :-1], np.maximum(sym[:, 1:], 0))
    valid = np.arange(width)[None, :] < size[:, None] - 1
    levels = [np.where(valid & (rank < NONE), rank * width + np.arange(width), NONE)]
    while levels[-1].shape[1] > 1:
        levels.append(np.minimum(levels[-1][:, ::2], levels[-1][:, 1::2]))
    live = np.flatnonzero(levels[-1][:, 0] < NONE)

    def put(rows: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
        levels[0][rows, pos] = value
        for below, level in zip(levels, levels[1:]):
            pos = pos >> 1
            level[rows, pos] = np.minimum(below[rows, 2 * pos], below[rows, 2 * pos + 1])

    def pairs(rows: np.ndarray, pos: np.ndarray) -> np.ndarray:
        right = nxt[rows, pos]
        ok = right < size[rows]
        rank, _ = voc.lookup(sym[rows, pos], np.maximum(sym[rows, np.minimum(right, width)], 0))
        return np.where(ok & (rank < NONE), rank * width + pos, NONE)

    while len(live):
        pos = levels[-1][live, 0] % width
        right = nxt[live, pos]
        _, into = voc.lookup(sym[live, pos], sym[live, right])
        sym[live, pos], sym[live, right] = into, -1
        after = nxt[live, right]
        nxt[live, pos] = after
        prv[live, np.minimum(after, width)] = pos
        put(live, right, np.full(len(live), NONE))  # right < size <= width
        put(live, pos, pairs(live, pos))
        left = prv[live, pos]
        has = left >= 0
        if has.any():
            put(live[has], left[has], pairs(live[has], left[has]))
        live = live[levels[-1][live, 0] < NONE]
    kept = sym[:, :width] >= 0
    ids = sym[:, :width][kept].astype("<u4").tobytes()
    ends = np.cumsum(kept.sum(axis=1)) * 4
    return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def merge_one(word: bytes, voc: Vocabulary) -> bytes:
    """The same for one piece of any length, with one tree in a flat list: n log n steps."""
    n = len(word)
    sym = voc.start[np.frombuffer(word, np.uint8)].tolist()
    width = 1 << max(1, (n - 1).bit_length())
    none = int(NONE)
    table = voc.__dict__.get("_table")
    if table is None:
        table = voc._table = {int(k): (int(r), int(i)) for k, r, i in zip(voc.pair, voc.rank, voc.into)}
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

    def value(pos: int) -> int:
        if pos < 0 or nxt[pos] >= n:
            return none
        hit = table.get((sym[pos] << 32) | sym[nxt[pos]])
        return hit[0] * width + pos if hit else none

    tree = [none] * (2 * width)
    tree[width : width + n] = [value(i) for i in range(n)]
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(pos: int, v: int) -> None:
        i = width + pos
        tree[i] = v
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low

    while tree[1] < none:
        pos = tree[1] % width
        right = nxt[pos]
        sym[pos] = table[(sym[pos] << 32) | sym[right]][1]
        sym[right] = -1
        nxt[pos] = nxt[right]
        if nxt[pos] < n:
            prv[nxt[pos]] = pos
        put(right, none)
        put(pos, value(pos))
        if prv[pos] >= 0:
            put(prv[pos], value(prv[pos]))
    return np.array([s for s in sym if s >= 0], "<u4").tobytes()


class Encoder:
    """Encodes batches of texts; keeps what it has merged, up to CACHE pieces."""

    def __init__(self, voc: Vocabulary):
        self.voc, self.cache, self.split = voc, {}, regex.compile(SPLIT)
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(voc.special, key=len, reverse=True)) + ")") if voc.special else None

    def split_text(self, text: str) -> list:
        """Pieces of the text; a special token is its id."""
        if self.special is None or not any(t in text for t in self.voc.special):
            return self.split.findall(text)
        out: list = []
        for i, part in enumerate(self.special.split(text)):
            out += [self.voc.special[part]] if i % 2 else self.split.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        parts = [self.split_text(t) for t in texts]
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = {p for x in parts for p in set(x) if p not in cache}
        extra: dict = {p: np.array([p], "<u4").tobytes() for p in new if isinstance(p, int)}
        raw = [(p, p.encode()) for p in new if isinstance(p, str)]
        for lo, hi in ((0, 4), (4, 8), (8, 16), (16, 32), (32, SHORT)):
            some = [(p, b) for p, b in raw if lo < len(b) <= hi]
            for i in range(0, len(some), 20_000):
                block = some[i : i + 20_000]
                extra.update(zip((p for p, _ in block), merge_many([b for _, b in block], self.voc)))
        cache.update(extra)
        extra = {p: merge_one(b, self.voc) for p, b in raw if len(b) > SHORT}
        get = cache.__getitem__ if not extra else lambda p: cache[p] if p in cache else extra[p]
        return [b"".join(map(get, x)) for x in parts]

    def decode(self, ids: bytes) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        table = self.voc.bytes
        return b"".join([table.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_encoders: dict[int, Encoder] = {}


def _round_trip(shared, passed: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = shared.value
        enc = _encoders.setdefault(id(voc), Encoder(voc))
        for piece in pieces(batches, "_text", CHUNK):
            ids = enc.encode(piece.column("_text").to_pylist())
            cols = [piece.column(c) for c in passed]
            cols += [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([enc.decode(i) for i in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*passed, "n_tokens", "ids", "decoded"])

    return run


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text and the text that they decode to.

    Returns `id_col`, n_tokens, ids (little-endian uint32, as binary) and decoded, one row for each input row.
    `vocabulary` is the path of a byte-level BPE file, read on the driver and broadcast: its size does not depend on the
    data. Special tokens found in a text are their ids, as in the file's own library. A null or empty text has no
    tokens and decodes to the empty text; ids may be null or repeated; other columns are left aside.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(vocabulary))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_round_trip(shared, ["_id"]), f"_id {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("_id", id_col)
