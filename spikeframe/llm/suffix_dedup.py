"""Removal of every long byte string that occurs more than once, by a distributed difference-cover suffix sort.

Sorting the suffixes of all texts would write many times the input, so the texts are first cut into pieces that can be
sorted apart. Of the 32-byte grams in a 200-byte string, the one of the least hash is its anchor; equal strings have equal
anchors, so only pieces around the same gram can share a string. Each start of a string belongs to one anchor.

1. Grams are counted; strings of grams that occur once occur once. A task sends a gram once for each chunk of its texts,
   with its count there and its first place; the chunk's other places are known to be repeated and go to their documents.
2. Documents with repeated grams send, for each such anchor, the piece of text that holds the strings it anchors. Pieces are
   dealt by gram. In a part, equal pieces are one; where a gram has several different pieces, these are concatenated and
   their suffixes sorted (sorted triples, recursion on names, merge of the remaining suffixes), and neighbours in that
   order are compared over the whole length of a string.
   What repeats within the texts that a task holds is covered there, and one of its places stands for all.
3. A gram with very many occurrences (a passage in a third of the documents) would fill one part. Its strings are hashed
   one by one instead, and repeats found by hash range, every chunk sending a hash once. At most HOT_GRAMS grams are told to
   all tasks; if more are hot, those of the highest counts by powers of two, and the others go the common way.
4. Covered bytes go back to their documents, where they merge into maximal runs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, byte_column, cut, deal, dealt, has_copies, keyed, mix, only_marked, pack, pieces, shown_id, span_hash, text_bytes, unpack
from .suffix_array import suffix_array

GRAM = 32
#: Occurrences from which a gram's strings are hashed one by one; text bytes handled at once; starts in a block.
HOT, CHUNK, BLOCK = 1000, 2 << 20, 1 << 19
#: Hot grams that are broadcast at most, eight bytes each.
HOT_GRAMS = 1 << 20
#: Text bytes for each part of grams; parts of pieces for each of these; bytes whose suffixes are sorted at once.
PART, FINER, SORTED = 16 << 20, 8, 200_000

Batches = Iterator[pa.RecordBatch]


def gram_hash(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position; k a power of two."""
    h, step, base = data.astype(np.uint64) + np.uint64(1), 1, BASE
    while step < k:
        h = h[: len(h) - step] * np.uint64(base) + h[step:]
        base, step = base * base % 2**64, step * 2
    return mix(h)


def string_hash(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` bytes from each position."""
    out, done, base = None, 0, BASE
    power, h, step = BASE, data.astype(np.uint64) + np.uint64(1), 1
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while True:  # the binary digits of length, lowest first
        if length & step:
            part = h[done : done + n]
            out = part.copy() if out is None else out * np.uint64(power) + part
            done += step
        if 2 * step > length:
            return mix(out)
        h = h[: len(h) - step] * np.uint64(power) + h[step:]
        power, step = power * power % 2**64, step * 2


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, at, lo, hi): anchors in the order of their strings' starts lo..hi (both included), in all texts."""
    out, w = [], length - GRAM + 1
    stop = np.repeat(offsets[1:] - length, np.diff(offsets))  # the last start in each byte's text
    for b in range(0, max(0, len(data) - length + 1), BLOCK):
        part = data[b : b + BLOCK + length - 1]
        starts = len(part) - length + 1
        g = gram_hash(part, GRAM)
        key = (g & ~np.uint64(2 * BLOCK - 1)) | np.arange(len(g), dtype=np.uint64)
        low, step = key, 1
        while 2 * step <= w:
            low, step = np.minimum(low[: len(low) - step], low[step:]), 2 * step
        low = np.minimum(low[:starts], low[w - step : w - step + starts])
        at = (low & np.uint64(2 * BLOCK - 1)).astype(np.int64)
        ok = np.flatnonzero(np.arange(b, b + starts) <= stop[b : b + starts])
        if not len(ok):
            continue
        new = np.ones(len(ok), bool)
        new[1:] = (at[ok][1:] != at[ok][:-1]) | (ok[1:] != ok[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(ok)) - 1
        out.append((mix(g[at[ok[first]]]), at[ok[first]] + b, ok[first] + b, ok[last] + b))  # least hashes are small: mixed anew, they fill all parts alike
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out))


def _firsts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct hash, in the order of the hashes, and how often it occurs."""
    by = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), h[by][1:] != h[by][:-1]]))
    return by[new], np.diff(np.append(new, len(h)))


def _send(h: np.ndarray, n: np.ndarray, at: np.ndarray, ids: np.ndarray, th: np.ndarray, first: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """One entry for each hash range: distinct hashes, in order, with their counts and first places."""
    doc = np.searchsorted(first, at, "right") - 1  # of empty texts at one place, the last, which is the one that has the byte
    at = at - first[doc]
    cuts = np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    for b, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(h)])):
        if lo < hi:
            used, own = np.unique(doc[lo:hi], return_inverse=True)
            yield b, pack(
                h=np.diff(h[lo:hi], prepend=np.uint64(0)), at=at[lo:hi].astype(np.uint32), n=n[lo:hi].astype(np.uint32),
                doc=own.astype(np.uint32), ids=np.diff(ids[used], prepend=0), th=th[used],
            )


def _met(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """(id, th, place in the text, hash, occurrences of the hash) of every place sent whose hash occurs at least twice."""
    kept = [unpack(blob) for blob in blobs]
    hs = [np.cumsum(x["h"]) for x in kept]
    h, n = np.concatenate(hs), np.concatenate([x["n"] for x in kept]).astype(np.int64)
    kind = np.unique(h, return_inverse=True)[1]
    total = np.bincount(kind, weights=n).astype(np.int64)[kind]
    out, lo = [], 0
    for x, own in zip(kept, hs):
        count = total[lo : lo + len(own)]
        lo += len(own)
        many = count > 1
        doc = x["doc"][many]
        out.append((np.cumsum(x["ids"])[doc], x["th"][doc].astype(np.int64), x["at"][many].astype(np.int64), own[many], count[many]))
    return tuple(np.concatenate(a) for a in zip(*out))


FOUND = "_id long, _th long, found array<struct<x:int,y:int>>"


def _by_document(ids: np.ndarray, th: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Table:
    """One row for each document with its (x, y), in the order of x."""
    by = np.lexsort((x, th, ids))
    ids, th, x, y = ids[by], th[by], x[by].astype(np.int32), y[by].astype(np.int32)
    cuts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (th[1:] != th[:-1])])) if len(ids) else np.zeros(0, np.int64)
    offsets = np.append(cuts, len(ids)).astype(np.int32)
    found = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))
    return pa.table({"_id": pa.array(ids[cuts], pa.int64()), "_th": pa.array(th[cuts], pa.int64()), "found": found})


def _found(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y) of all rows, one behind the other, and the number of each row."""
    flat = col.flatten()
    return *(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("x", "y")), col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _chunks(batches: Batches) -> Iterator[tuple]:
    for piece in pieces(batches, "_text", CHUNK):
        pa.default_memory_pool().release_unused()
        data, offsets = byte_column(piece.column("_text"))
        yield piece, piece.column("_id").to_numpy(), piece.column("_th").to_numpy().astype(np.uint32), data, offsets


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32()] * (len(names) - 1) + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _grams(length: int, bits: int, docs: int) -> Callable[[Batches], Batches]:
    """Grams by hash range (kind 0), and by document the places of those that a chunk holds already (kind 1)."""

    def run(batches: Batches) -> Batches:
        for _, ids, th, data, offsets in _chunks(batches):
            gram, at, _, _ = anchors(data, offsets, length)
            if not len(gram):
                continue
            first, n = _firsts(gram)
            rows = [(0, b, blob) for b, blob in _send(gram[first], n, at[first], ids, th, offsets[:-1], bits)]
            rest = np.ones(len(gram), bool)
            rest[first] = False
            doc = np.searchsorted(offsets, at[rest], "right") - 1
            rows += [(1, p, blob) for p, blob in deal(ids[doc], th[doc], at[rest] - offsets[doc], docs)]
            yield _rows(rows, ["kind", "part", "entries"])

    return run


def _repeated_grams(hot: int, docs: int) -> Callable[[pa.Table], pa.Table]:
    """Places of repeated grams by document (kind 1); hot grams (kind 2), `part` being the power of two of their counts."""

    def run(group: pa.Table) -> pa.Table:
        if group.column("kind")[0].as_py() == 1:
            return group.append_column("n", pa.array([0] * group.num_rows, pa.int64()))
        ids, th, at, gram, count = _met(group.column("entries").to_pylist())
        rows = [(1, p, blob, 0) for p, blob in deal(ids, th, at, docs)]
        often, which = np.unique(gram[count >= hot], return_index=True)
        power = np.log2(count[count >= hot][which] / hot).astype(np.int64)
        rows += [(2, p, pack(gram=often[power == p]), int((power == p).sum())) for p in np.unique(power).tolist()]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int64()]
        return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(zip(("kind", "part", "entries", "n"), kinds))})

    return run


def hot_grams(told: DataFrame, most: int) -> np.ndarray:
    """The hot grams in order; of more than `most`, those of the highest powers of two that fit."""
    hot, least, n = told.where("kind = 2"), None, 0
    for r in sorted(hot.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r["part"]):  # at most 64 rows
        n += r["n"]
        if n > most:
            break
        least = r["part"]
    if least is None:
        return np.zeros(0, np.uint64)
    return np.sort(np.concatenate([unpack(r["entries"])["gram"] for r in hot.where(F.col("part") >= least).select("entries").collect()]))  # at most `most` grams


def _places(group: pa.Table) -> pa.Table:
    """(_id, _th, places): where repeated grams stand in the documents of one part."""
    ids, th, at = (np.concatenate(x) for x in zip(*(dealt(b) for b in group.column("entries").to_pylist())))
    found = _by_document(ids, th.astype(np.int64), at, at)
    places = found.column("found").combine_chunks()
    return found.select(["_id", "_th"]).append_column("places", pa.ListArray.from_arrays(places.offsets, places.flatten().field("x")))


def _equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of entries equal in all keys, in the order of the last key, and whether an entry has an equal one."""
    by = np.lexsort(keys)
    new = np.ones(len(by), bool)
    new[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    kind = np.empty(len(by), np.int64)
    kind[by] = np.cumsum(new) - 1
    return by[new], (np.bincount(kind) > 1)[kind]


def _spans_by_part(ids: np.ndarray, th: np.ndarray, lo: np.ndarray, hi: np.ndarray, docs: int) -> Iterator[tuple[int, bytes]]:
    """Covered intervals, merged and packed for each of `docs` parts of the documents."""
    ids, th, lo, hi = _runs(ids, th, lo, hi)
    if not len(ids):
        return
    to = (mix(ids.view(np.uint64) ^ mix(th.astype(np.uint64))) % np.uint64(docs)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    for k in np.split(by, np.flatnonzero(np.diff(to[by])) + 1):
        yield int(to[k[0]]), pack(ids=ids[k], th=th[k].astype(np.uint32), lo=lo[k].astype(np.uint32), hi=hi[k].astype(np.uint32))


def _cut_pieces(length: int, bits: int, docs: int, hot) -> Callable[[Batches], Batches]:
    """Pieces around repeated grams by gram (kind 0), string hashes of hot grams by hash (kind 1), covered intervals (kind 2).

    What repeats within the texts at hand is covered at once, and one of the equal pieces or hashes stands for all.
    """

    def run(batches: Batches) -> Batches:
        for piece, ids, th, data, offsets in _chunks(batches):
            places = piece.column("places")
            told = np.sort(places.flatten().to_numpy() + np.repeat(offsets[:-1], places.value_lengths().to_numpy(zero_copy_only=False)))
            gram, at, lo, hi = anchors(data, offsets, length)
            if not len(at):
                continue
            where = np.minimum(np.searchsorted(told, at), len(told) - 1)
            known = told[where] == at
            often = known & np.isin(gram, hot.value)
            rows, seen = [], []
            if often.any():
                some = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo[often], hi[often])])
                h = np.concatenate([string_hash(data[a : b + length], length) for a, b in zip(lo[often], hi[often])])
                first, twice = _equal(h)
                rows += [(1, b, blob) for b, blob in _send(h[first], np.ones(len(first)), some[first], ids, th, offsets[:-1], bits)]
                doc = np.searchsorted(offsets, some[twice], "right") - 1
                seen.append((ids[doc], th[doc], some[twice] - offsets[doc], some[twice] - offsets[doc] + length))
            sel = np.flatnonzero(known & ~often)
            if len(sel):
                first, twice = _equal(span_hash(data, lo[sel], hi[sel] + length), gram[sel])
                k = sel[twice]
                doc = np.searchsorted(offsets, lo[k], "right") - 1
                seen.append((ids[doc], th[doc], lo[k] - offsets[doc], hi[k] + length - offsets[doc]))
                sel = sel[first]
                part = (gram[sel] >> np.uint64(64 - bits)).astype(np.int64)
                doc = np.searchsorted(offsets, lo[sel], "right") - 1
                for p in np.unique(part).tolist():
                    mine = np.flatnonzero(part == p)
                    k, d = sel[mine], doc[mine]
                    size = hi[k] + length - lo[k]
                    text = np.concatenate([data[a:b] for a, b in zip(lo[k], hi[k] + length)])
                    rows.append((0, p, pack(gram=gram[k], id=ids[d], th=th[d], lo=(lo[k] - offsets[d]).astype(np.uint32), size=size.astype(np.uint32), text=text)))
            if seen:
                rows += [(2, p, blob) for p, blob in _spans_by_part(*(np.concatenate(x) for x in zip(*seen)), docs)]
            for i in range(0, len(rows), 64):
                yield _rows(rows[i : i + 64], ["kind", "part", "entries"])

    return run


def repeated_starts(text: np.ndarray, cuts: np.ndarray, length: int) -> np.ndarray:
    """Positions in the pieces text[cuts[i]:cuts[i + 1]] that start a string of `length` bytes found at another one too."""
    n, size = len(cuts) - 1, np.diff(cuts)
    s = np.empty(len(text) + n, np.int64)
    of = np.repeat(np.arange(n), size)
    s[np.arange(len(text)) + of] = text.astype(np.int64) + n + 1
    s[cuts[1:] + np.arange(n)] = np.arange(1, n + 1)  # each piece ends in a symbol of its own
    left = np.zeros(len(s), np.int64)
    left[np.arange(len(text)) + of] = cuts[of + 1] - np.arange(len(text))
    order = suffix_array(s)
    order = order[left[order] >= length]
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    for k in range(length):  # most neighbours part early
        if not len(same):
            break
        same = same[s[a[same] + k] == s[b[same] + k]]
    hit = np.unique(np.concatenate([a[same], b[same]]))
    back = np.full(len(s), -1, np.int64)
    back[np.arange(len(text)) + of] = np.arange(len(text))
    return back[hit]


def _covered(length: int, docs: int) -> Callable[[pa.Table], pa.Table]:
    """(part, entries): covered byte intervals, packed for each of `docs` parts of the documents."""

    def sent(ids: np.ndarray, th: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Table:
        rows = list(_spans_by_part(ids, th, lo, hi, docs))
        return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "entries": pa.array([r[1] for r in rows], pa.binary())})

    def run(group: pa.Table) -> pa.Table:
        blobs = group.column("entries").to_pylist()
        if group.column("kind")[0].as_py() == 1:
            ids, th, at, *_ = _met(blobs)
            return sent(ids, th, at, at + length)
        xs = [unpack(b) for b in blobs]
        if group.column("kind")[0].as_py() == 2:
            return sent(*(np.concatenate([x[k].astype(np.int64) for x in xs]) for k in ("ids", "th", "lo", "hi")))
        gram, ids, lo, size, text = (np.concatenate([x[k] for x in xs]) for k in ("gram", "id", "lo", "size", "text"))
        th = np.concatenate([x["th"] for x in xs]).astype(np.int64)
        lo, size = lo.astype(np.int64), size.astype(np.int64)
        ends = np.cumsum(size)
        starts = ends - size
        # equal pieces of a gram are one; if there are two, all of both is covered
        h = span_hash(text, starts, ends)
        reps, twice = _equal(h, gram)
        out = [(ids[twice], th[twice], lo[twice], lo[twice] + size[twice])]
        fresh = np.ones(len(reps), bool)
        fresh[1:] = gram[reps][1:] != gram[reps][:-1]
        per_gram = np.bincount(np.cumsum(fresh) - 1)
        reps = reps[per_gram[np.cumsum(fresh) - 1] > 1]
        fill = np.cumsum(size[reps])
        g = gram[reps]
        a = 0
        while a < len(reps):  # whole grams, up to SORTED bytes at a time
            b = max(a + 1, int(np.searchsorted(fill, (fill[a - 1] if a else 0) + SORTED, "right")))
            while b < len(reps) and g[b] == g[b - 1]:
                b += 1
            some = reps[a:b]
            cuts = np.concatenate([[0], np.cumsum(size[some])])
            at = repeated_starts(np.concatenate([text[starts[i] : ends[i]] for i in some]), cuts, length)
            which = np.searchsorted(cuts, at, "right") - 1
            k = some[which]
            out.append((ids[k], th[k], lo[k] + at - cuts[which], lo[k] + at - cuts[which] + length))
            a = b
        return sent(*(np.concatenate(x) for x in zip(*out)))

    return run


def _runs(ids: np.ndarray, th: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Overlapping and touching intervals of a document merged."""
    by = np.lexsort((lo, th, ids))
    ids, th, lo, hi = ids[by], th[by], lo[by], hi[by]
    if not len(lo):
        return ids, th, lo, hi
    doc = np.cumsum(np.concatenate([[0], (ids[1:] != ids[:-1]) | (th[1:] != th[:-1])]))
    far = np.maximum.accumulate(hi + (doc << np.int64(33))) - (doc << np.int64(33))
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > far[:-1])])
    last = np.append(np.flatnonzero(new)[1:], len(lo)) - 1
    return ids[new], th[new], lo[new], far[last]


def _joined(group: pa.Table) -> pa.Table:
    """(_id, _th, found): the merged intervals of the documents of one part."""
    xs = [unpack(b) for b in group.column("entries").to_pylist()]
    return _by_document(*_runs(*(np.concatenate([x[k].astype(np.int64) for x in xs]) for k in ("ids", "th", "lo", "hi"))))


def merge_intervals(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(lo.tolist(), hi.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _remove(batches: Batches) -> Batches:
    for batch in pieces(batches, "_text", CHUNK):
        out = []
        lo, hi, size = _found(batch.column("found"))
        stop = np.cumsum(size)
        for text, a, b in zip(batch.column("_text").to_pylist(), (stop - size).tolist(), stop.tolist()):
            raw, spans = text.encode(), merge_intervals(lo[a:b], hi[a:b])
            kept, end = [], 0
            for first, last in spans:
                kept.append(raw[end:first])
                end = last
            kept = b"".join([*kept, raw[end:]])
            out.append((len(raw) - len(kept), [{"start": a, "end": b} for a, b in spans], kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), batch.column("_th"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([o[2] for o in out], pa.binary())],
            ["_id", "_th", "n_removed", "spans", "kept"],
        )


def dedup_suffixes(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Bytes that go and bytes that stay, for every document.

    Returns `id_col`, n_bytes, n_removed, spans (maximal byte intervals [start, end)), kept (the remaining bytes; null
    where nothing goes, as then they are the whole text) and kept_sha256, one row for each input row.
    A byte goes if a string of `length` bytes covers it that also starts anywhere else, in any text. Strings never cross
    texts; a null text is empty. Rows that share id and text are one document. Shorter texts keep all. `length` is at
    least 64. Grams of `hot` or more occurrences go the other way. Other columns are left aside. Pieces and hot strings are compared by 64-bit hashes, the rest byte by byte.
    """
    if length < 2 * GRAM:
        raise ValueError("length must be at least 64")
    rows = keyed(docs, id_col, text_col)
    bits = min(24, max(6, math.ceil(math.log2(max(1, text_bytes(docs, text_col) / PART)))))
    grams = rows.dropDuplicates(["_id", "_th"]) if has_copies(docs, id_col) else rows
    sent = grams.mapInArrow(_grams(length, bits, 1 << bits), "kind int, part int, entries binary")
    told = cut(sent.groupBy("kind", "part").applyInArrow(_repeated_grams(hot, 1 << bits), "kind int, part int, entries binary, n long"))
    often = docs.sparkSession.sparkContext.broadcast(hot_grams(told, HOT_GRAMS))
    anchored = cut(told.where("kind = 1").groupBy("part").applyInArrow(_places, "_id long, _th long, places array<int>"))
    finer = min(24, bits + FINER.bit_length() - 1)
    cut_up = only_marked(grams, anchored).join(anchored, ["_id", "_th"]).mapInArrow(_cut_pieces(length, finer, 1 << bits, often), "kind int, part int, entries binary")
    covered = cut_up.groupBy("kind", "part").applyInArrow(_covered(length, 1 << bits), "part int, entries binary")
    spans = cut(covered.groupBy("part").applyInArrow(_joined, FOUND))
    cleaned = only_marked(grams, spans).join(spans, ["_id", "_th"]).mapInArrow(_remove, "_id long, _th long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
    every = rows.select("_id", "_th", F.octet_length("_text").cast("long").alias("n_bytes"), F.sha2("_text", 256).alias("plain"))
    return every.join(cleaned, ["_id", "_th"], "left").select(
        shown_id().alias(id_col),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"),
        "kept",
        F.coalesce(F.sha2("kept", 256), "plain").alias("kept_sha256"),
    )

