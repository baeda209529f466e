"""Substring deduplication by Rabin-Karp hashes of every fixed-length token window.

1. Each task hashes all windows of its documents, some million at a time, and keeps of every hash the first place; the
   others are repeats at once. So a passage that a third of the documents share sends one place for some million windows.
2. The places are dealt by the leading hash bits, one compressed row for each hash range, which names the documents
   that it uses and no others: what is sent grows with the text, not with the number of ranges. In each range, equal hashes
   of all tasks meet; all but the earliest place, by (document, position), are repeats.
3. Repeats, those of step 1 directly, go to their documents' parts, where the windows' words merge into maximal removal
   intervals.

Windows are compared by a 64-bit hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column, cut, deal, dealt, keyed, only_marked, pack, pieces, rows_of, shown_id, span_hash, text_bytes, unpack, window_hash, word_spans

#: Text bytes hashed at once, windows sorted at once, text bytes for each hash range; hash ranges for each part of the documents.
CHUNK, SORTED, RANGE, COARSER = 6 << 20, 4_000_000, 16 << 20, 4

Batches = Iterator[pa.RecordBatch]


def split_repeats(h: np.ndarray, i: np.ndarray, t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places (id, th, position) with hashes: the earliest of each hash, in the order of hashes, and those that repeat one.

    The same place given twice, as by a document that stands twice in the table, does not repeat itself.
    """
    by = np.argsort(h)
    s = h[by]
    equal = s[1:] == s[:-1]
    several = np.zeros(len(h), bool)
    several[1:] |= equal
    several[:-1] |= equal
    starts = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), ~equal]))
    some = by[several]
    some = some[np.lexsort((p[some], t[some], i[some], h[some]))]
    new = np.ones(len(some), bool)
    new[1:] = h[some][1:] != h[some][:-1]
    lead = some[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))] if len(some) else some
    late = some[(i[some] != i[lead]) | (t[some] != t[lead]) | (p[some] != p[lead])]
    first = by[starts]
    first[several[starts]] = some[new]
    return first, late


def _send(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, th: np.ndarray, bits: int, parts: int) -> Iterator[tuple[int, int, bytes]]:
    """(kind, part, entries): earliest places by hash range (kind 0), the others by their documents' part (kind 1)."""
    order = np.lexsort((th, ids))
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    ids, th, doc = ids[order], th[order], place[doc]
    first, late = split_repeats(h, ids[doc], th[doc], pos)
    yield from ((1, part, blob) for part, blob in deal(ids[doc[late]], th[doc[late]], pos[late], parts))
    h, doc, pos = h[first], doc[first], pos[first]
    cuts = np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    for b, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(h)])):
        if lo < hi:
            used, own = np.unique(doc[lo:hi], return_inverse=True)
            yield 0, b, pack(h=np.diff(h[lo:hi], prepend=np.uint64(0)), doc=own.astype(np.uint32), pos=pos[lo:hi], ids=np.diff(ids[used], prepend=0), th=th[used])


def _entries(width: int, bits: int, parts: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        held: list[tuple] = []
        size = docs = 0

        def sent() -> Batches:
            h, doc, pos, ids, th = (np.concatenate(x) for x in zip(*held))
            held.clear()
            yield from rows_of(_send(h, doc, pos, ids, th, bits, parts), ["kind", "part", "entries"])

        for piece in pieces(batches, "_text", CHUNK):
            data, offsets = byte_column(piece.column("_text"))
            starts, ends, first = word_spans(data, offsets)
            h = window_hash(span_hash(data, starts, ends), width)
            last = np.repeat(first[1:], np.diff(first))[: len(h)]
            at = np.flatnonzero(np.arange(len(h)) + width <= last)
            doc = np.searchsorted(first, at, "right") - 1
            held.append((h[at], (doc + docs).astype(np.uint32), (at - first[doc]).astype(np.uint32), piece.column("_id").to_numpy(), piece.column("_th").to_numpy().astype(np.uint32)))
            size, docs = size + len(at), docs + piece.num_rows
            if size >= SORTED:
                yield from sent()
                size = docs = 0
        if size:
            yield from sent()

    return run


def _repeats(parts: int) -> Callable[[pa.Table], pa.Table]:
    """(part, entries): the repeated windows of a hash range, by their documents' part; what is dealt so already passes."""

    def run(group: pa.Table) -> pa.Table:
        if group.column("kind")[0].as_py() == 1:
            return group.select(["part", "entries"])
        hs, ids, ths, pos = [], [], [], []
        for blob in group.column("entries").to_pylist():
            x = unpack(blob)
            hs.append(np.cumsum(x["h"]))
            ids.append(np.cumsum(x["ids"])[x["doc"]])
            ths.append(x["th"][x["doc"]])
            pos.append(x["pos"])
        h, i, t, p = (np.concatenate(a) for a in (hs, ids, ths, pos))
        late = split_repeats(h, i, t, p)[1]
        rows = list(deal(i[late], t[late], p[late], parts))
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "entries": pa.array([r[1] for r in rows], pa.binary())})

    return run


def merge_windows(at: np.ndarray, width: int) -> np.ndarray:
    """Maximal intervals [start, end) covered by the windows that start at `at`; shape (n, 2)."""
    at = np.unique(at)
    if not len(at):
        return np.zeros((0, 2), np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + width]))
    return np.stack([at[new], np.concatenate([at[new[1:] - 1], at[-1:]]) + width], axis=1)


SPANS = "array<struct<start:long,end:long>>"


def _merged(width: int) -> Callable[[pa.Table], pa.Table]:
    """(_id, _th, spans) of each document of a part that has repeated windows."""

    def run(group: pa.Table) -> pa.Table:
        i, t, p = (np.concatenate(x) for x in zip(*(dealt(b) for b in group.column("entries").to_pylist())))
        by = np.lexsort((p, t, i))
        i, t, p = i[by], t[by], p[by].astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (t[1:] != t[:-1])]))
        spans = [[{"start": a, "end": b} for a, b in merge_windows(x, width).tolist()] for x in np.split(p, cuts[1:])]
        return pa.table({"_id": pa.array(i[cuts], pa.int64()), "_th": pa.array(t[cuts].astype(np.int64), pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    return run


def _removed(batches: Batches) -> Batches:
    for batch in batches:
        n, texts = [], []
        for text, spans in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist()):
            words = text.encode().split()
            kept, end = [], 0
            for span in spans:
                kept += words[end : span["start"]]
                end = span["end"]
            kept += words[end:]
            n.append(len(words) - len(kept))
            texts.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), pa.array(n, pa.int64()), batch.column("spans"), pa.array(texts, pa.string())], ["_id", "_th", "n_removed", "spans", "kept"])


def _plain(batches: Batches) -> Batches:
    import hashlib

    for batch in batches:
        n, sha = [], []
        for text in batch.column("_text").to_pylist():
            words = text.encode().split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["_id", "_th", "n_words", "plain_sha256"])


def hash_ranges(size: int) -> int:
    """Leading hash bits that deal `size` bytes of text into ranges."""
    return min(24, max(6, math.ceil(math.log2(max(1, size / RANGE)))))


def repeated_windows(rows: DataFrame, width: int, bits: int) -> DataFrame:
    """(_id, _th, spans): of each document of (_id, _th, _text) with repeated windows, the intervals of words that they cover."""
    parts = max(16, (1 << bits) // COARSER)
    entries = rows.mapInArrow(_entries(width, bits, parts), "kind int, part int, entries binary")
    found = entries.groupBy("kind", "part").applyInArrow(_repeats(parts), "part int, entries binary")
    return found.groupBy("part").applyInArrow(_merged(width), f"_id long, _th long, spans {SPANS}")


def dedup_substrings(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removal intervals and kept words of every document.

    Returns `id_col`, n_words, n_removed, spans (word intervals [start, end)), kept (the kept words joined by one
    space; null where nothing goes, as then it is the whole text) and kept_sha256, one row for each input row.
    A word goes if a window of `width` words covers it whose words also start earlier: in a document with a smaller id,
    or before in the same one. A null text has no words, a null id comes first. Of rows that share an id, the texts'
    hashes give the order; rows that share id and text are one document and get the same result. Texts of fewer words
    than a window keep all. Other columns are left aside.
    """
    if width < 1:
        raise ValueError("width must be positive")
    rows = keyed(docs, id_col, text_col)
    found = cut(repeated_windows(rows, width, hash_ranges(text_bytes(docs, text_col))))
    cleaned = only_marked(rows, found).join(found, ["_id", "_th"]).mapInArrow(_removed, f"_id long, _th long, n_removed long, spans {SPANS}, kept string").dropDuplicates(["_id", "_th"])
    every = rows.mapInArrow(_plain, "_id long, _th long, n_words long, plain_sha256 string")
    return every.join(cleaned, ["_id", "_th"], "left").select(
        shown_id().alias(id_col),
        "n_words",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
        "kept",
        F.coalesce(F.sha2("kept", 256), "plain_sha256").alias("kept_sha256"),
    )
