"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found through a block-max inverted index.

1. A bounded sample of labelled texts, half of each label where there are enough, gives the examples. Every word in them,
   and the first five letters of every longer one, is a term.
2. Document frequencies of the terms are counted over all documents. A term weighs (1 + ln count) * idf * (|z| + 0.1) in a
   text, z being the two-sample z-score of its presence by label: supervised TF-IDF, in which a term that says nothing
   about the label still counts, but little. Vectors have length 1.
3. Examples with equal vectors become one entry with the weight of each label. An inverted index holds, for each term, the
   entries and their weights, and the largest weight in each block of entries. The terms of many entries give every
   entry a first part of its product; with the block maxima of the others, that bounds each block, and only blocks whose
   bound reaches the k-th best first part are scored: the k nearest are exact.
4. Neighbours vote by their distance; the vote is calibrated by isotonic regression on the examples' own votes, each made
   without the example itself. Labels weigh as much as they do among all labelled rows.

Labels enter only through the training rows given; language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, pack, pieces, restored, unpack

WORD = re.compile(r"[^\W\d_]+")
STEM = 5
#: Entries of an index block; neighbours; weight of the prior in a vote; weight of a term that says nothing.
BLOCK, NEIGHBOURS, PRIOR, FLOOR = 64, 25, 0.05, 0.1
#: Text bytes handled at once; terms in a row of document frequencies; queries multiplied at once; words that a task keeps;
#: share of the entries, as one in so many, from which a term has a row.
CHUNK, SLICE, TOGETHER, KEPT_WORDS, OFTEN = 4 << 20, 1 << 13, 64, 100_000, 16

Batches = Iterator[pa.RecordBatch]


def terms(text: str) -> list[str]:
    """Words of letters, lower-cased, and "^" with the first letters of longer ones; repeats included."""
    words = WORD.findall(text.lower())
    return words + ["^" + w[:STEM] for w in words if len(w) > STEM]


def _terms_of(batches: Batches) -> Batches:
    for piece in pieces(batches, "_text", CHUNK):
        found = [terms(t) for t in piece.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([piece.column("_id"), piece.column("toxic"), pa.array(found, pa.list_(pa.string()))], ["_id", "toxic", "terms"])


class Lookup(dict):
    """Numbers of terms: of a word, its own and its stem's, each from 1 (0: no term), in one number. Keeps what it has looked up."""

    def __init__(self, vocabulary: pa.Array):
        names = vocabulary.to_pylist()
        self.words = {w: i + 1 for i, w in enumerate(names) if w[0] != "^"}
        self.stems = {w[1:]: i + 1 for i, w in enumerate(names) if w[0] == "^"}

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        code = self.words.get(word, 0) | (self.stems.get(word[:STEM], 0) << 32 if len(word) > STEM else 0)
        if len(word) < 32:
            self[word] = code
        return code

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The terms that occur in the text, in order, and how often."""
        words = WORD.findall(text.lower())
        code = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        found = np.sort(np.concatenate([code & 0xFFFFFFFF, code >> 32]))
        found = found[np.searchsorted(found, 1) :]
        first = np.flatnonzero(np.concatenate([np.ones(min(len(found), 1), bool), found[1:] != found[:-1]]))
        return found[first] - 1, np.diff(np.append(first, len(found)))


def unit(w: np.ndarray) -> np.ndarray:
    return w / np.sqrt((w * w).sum()) if len(w) else w


def _counted(vocabulary, kept: list[str]) -> Callable[[Batches], Batches]:
    """The rows' columns `kept`, and the terms of their texts, packed."""

    def run(batches: Batches) -> Batches:
        lookup = Lookup(vocabulary.value)
        for piece in pieces(batches, "_text", CHUNK):
            found = [lookup(t) for t in piece.column("_text").to_pylist()]
            packed = [pack(t=np.diff(t, prepend=0).astype(np.uint32), n=n.astype(np.uint32)) for t, n in found]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(packed, pa.binary())], [*kept, "_terms"])

    return run


def _terms(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = unpack(blob)
    return np.cumsum(x["t"], dtype=np.int64), x["n"]


def _frequencies(size: int) -> Callable[[Batches], Batches]:
    """(slice, counts): in how many of a task's texts each of `size` terms occurs, and last, the number of texts."""

    def run(batches: Batches) -> Batches:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            for blob in batch.column("_terms").to_pylist():
                total[_terms(blob)[0]] += 1
                total[-1] += 1
        if total[-1]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(0, len(total), SLICE), pa.int32()), pa.array([pack(n=total[lo : lo + SLICE]) for lo in range(0, len(total), SLICE)], pa.binary())], ["slice", "counts"])

    return run


def _summed(group: pa.Table) -> pa.Table:
    total = 0
    for blob in group.column("counts").to_pylist():
        total = total + unpack(blob)["n"]
    return pa.table({"slice": group.column("slice").slice(0, 1), "counts": pa.array([pack(n=total)], pa.binary())})


def document_frequencies(rows: DataFrame, frequencies: Callable[[Batches], Batches], size: int) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many of them each of `size` terms occurs. The driver gets as many numbers as there are terms."""
    found = rows.mapInArrow(frequencies, "slice int, counts binary").groupBy("slice").applyInArrow(_summed, "slice int, counts binary")
    out = np.zeros(size + 1, np.int64)
    for r in found.collect():
        part = unpack(r["counts"])["n"]
        out[r["slice"] : r["slice"] + len(part)] = part
    return int(out[-1]), out[:-1]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[i] to first[i] + n[i] - 1, one range behind the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


class BlockMaxIndex:
    """Entries (distinct vectors) with the weight of both labels, and their inverted index with the maxima of blocks.

    A term of one in OFTEN entries or more has its postings in full, as a row of a matrix, in single precision too.
    """

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, weight: np.ndarray, docs: list, n_terms: int):
        self.toxic, self.weight, self.docs = toxic, weight, docs
        self.n, self.blocks = len(entries), -(-len(entries) // BLOCK)
        at = np.repeat(np.arange(self.n), [len(t) for t, _ in entries])
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in entries)])
        value = np.concatenate([np.zeros(0), *(w for _, w in entries)])
        often = np.bincount(term, minlength=n_terms) * OFTEN >= max(self.n, 1)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), self.blocks * BLOCK))
        full = often[term]
        self.rows[self.row[term[full]], at[full]] = value[full]
        self.single = self.rows.astype(np.float32)
        # products of vectors of length 1, added up in single precision, are off by less than this
        self.slack = (len(self.rows) + 8) * 2.0**-23
        # by term, for the others
        at, term, value = at[~full], term[~full], value[~full]
        by = np.lexsort((at, term))
        at, term, self.posted = at[by], term[by], value[by]
        self.entry = at.astype(np.int32)
        key = term * np.int64(max(self.blocks, 1)) + at // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.top_first = np.append(first, len(key))
        self.top_block = (at[first] // BLOCK).astype(np.int32)
        self.top = np.maximum.reduceat(self.posted, first) if len(first) else np.zeros(0)
        self.of_term = np.searchsorted(term[first], np.arange(n_terms + 1))

    def often(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The products of each query with every entry over the terms that are rows, in single precision."""
        x = np.zeros((len(queries), len(self.rows)), np.float32)
        for i, (t, w) in enumerate(queries):
            row = self.row[t]
            x[i, row[row >= 0]] = w[row >= 0]
        return x @ self.single

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int, dot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """The k entries of largest positive cosine, the cosines, and the blocks scored; ties go to the lower entry.

        `dot`: what often() gives for this query. Weights are positive, so a part of a product is a lower bound of it.
        """
        dot = self.often([(t, w)])[0] if dot is None else dot
        row = self.row[t]
        rare = row < 0
        first = self.of_term[t[rare]]
        n = self.of_term[t[rare] + 1] - first
        at, x = _ranges(first, n), np.repeat(w[rare], n)
        block = self.top_block[at]
        bound = dot.reshape(self.blocks, BLOCK).max(axis=1, initial=0) + np.bincount(block, x * self.top[at], self.blocks)
        least = max(np.partition(dot, len(dot) - k)[len(dot) - k] if len(dot) >= k else 0.0, 0.0) - 2 * self.slack
        active = (bound >= least) & (bound > 0)
        some = np.flatnonzero(active[block])
        lo = self.top_first[at[some]]
        m = self.top_first[at[some] + 1] - lo
        p = _ranges(lo, m)
        rest = np.bincount(self.entry[p], np.repeat(x[some], m) * self.posted[p], len(dot))
        about = dot + rest
        about[np.repeat(~active, BLOCK)] = 0.0
        able = np.flatnonzero(about > 0)
        if len(able) > k:
            able = able[about[able] >= np.partition(about[able], len(able) - k)[len(able) - k] - 2 * self.slack]
        # exact for those that may be among the k: in double precision, in the order of the terms
        cos = rest[able] + (self.rows[row[~rare][:, None], able] * w[~rare][:, None]).sum(axis=0)
        by = np.lexsort((able, -cos))[:k]
        return able[by], cos[by], int(active.sum())

    def vote(self, t: np.ndarray, w: np.ndarray, base: float, own: tuple[int, float, float] | None = None, dot: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray, int]:
        """Share of toxic weight among the neighbours; own: an entry, and the weights of it to leave out."""
        entry, cos, scored = self.nearest(t, w, NEIGHBOURS + (own is not None), dot)
        toxic, weight = self.toxic[entry].copy(), self.weight[entry].copy()
        if own is not None:
            same = entry == own[0]
            toxic[same] -= own[1]
            weight[same] -= own[2]
        return float(((cos * toxic).sum() + PRIOR * base) / (np.maximum(cos * weight, 0).sum() + PRIOR)), entry, cos, scored


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the nondecreasing step function closest to y in weighted squares (pool adjacent violators)."""
    by = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # mean, weight, first x, last x
    for xi, yi, wi in zip(x[by].tolist(), y[by].tolist(), w[by].tolist()):
        pools.append([yi, wi, xi, xi])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            b, a = pools.pop(), pools.pop()
            total = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2], b[3]])
    at = np.array([v for p in pools for v in (p[2], p[3])])
    return at, np.array([v for p in pools for v in (p[0], p[0])])


class Model:
    """Term weights, index and calibration. Its size is bounded by the examples taken."""

    def __init__(self, weight: np.ndarray, examples: list[tuple[int, np.ndarray, np.ndarray, int]], mass: dict[int, float]):
        """examples: (document, terms, counts, label)."""
        self.term_weight, self.mass = weight, mass
        of: dict[tuple, list] = {}
        for doc, t, count, y in examples:
            of.setdefault((t.tobytes(), count.tobytes()), []).append((doc, t, count, y))
        total = sum(mass[y] for *_, y in examples)
        self.base = sum(mass[1] for *_, y in examples if y) / total if total else 0.0
        none = of.pop((b"", b""), [])
        n = sum(mass[y] for *_, y in none)
        self.empty = (sum(mass[1] for *_, y in none if y) + self.base) / (n + 1)
        self.none = n
        groups = [(group, group[0][1], unit((1 + np.log(group[0][2])) * weight[group[0][1]])) for group in of.values()]
        # entries that share their heaviest terms stand in the same blocks, which keeps the maxima telling
        groups.sort(key=lambda g: (*g[1][np.argsort(-g[2], kind="stable")[:4]].tolist(), min(d for d, *_ in g[0])))
        self.groups = [([(doc, y) for doc, _, _, y in group], t, w) for group, t, w in groups]
        toxic = np.array([sum(mass[1] for _, y in g if y) for g, *_ in self.groups])
        every = np.array([sum(mass[y] for _, y in g) for g, *_ in self.groups])
        self.index = BlockMaxIndex([(t, w) for _, t, w in self.groups], toxic, every, [min(d for d, _ in g) for g, *_ in self.groups], len(weight))
        self.at, self.level = np.zeros(1), np.zeros(1)

    def own_votes(self, entries: list[int]) -> list[tuple[float, float, float]]:
        """(vote without the example, its label, weight) of the examples in the given entries; equal ones together."""
        out = []
        for i in entries:
            group, t, w = self.groups[i]
            for y in sorted({y for _, y in group}):
                vote = self.index.vote(t, w, self.base, (i, self.mass[1] * y, self.mass[y]))[0]
                out.append((vote, float(y), self.mass[y] * sum(y == label for _, label in group)))
        return out

    def calibrate(self, votes: list[tuple[float, float, float]]) -> None:
        x, y, w = zip(*sorted([(self.empty, self.empty, max(self.none, 1.0)), *votes]))
        self.at, self.level = isotonic(np.array(x), np.array(y), np.array(w))
        self.groups = []  # scores need the index alone

    def scores(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list[tuple[int, float, float]], int]]:
        """score() of each."""
        for lo in range(0, len(queries), TOGETHER):
            some = queries[lo : lo + TOGETHER]
            for (t, w), dot in zip(some, self.index.often(some)):
                yield self.score(t, w, dot)

    def score(self, t: np.ndarray, w: np.ndarray, dot: np.ndarray | None = None) -> tuple[float, list[tuple[int, float, float]], int]:
        """Calibrated score, up to three neighbours (document, cosine, share of toxic labels), and the blocks scored."""
        index = self.index
        raw, entry, cos, scored = index.vote(t, w, self.base, dot=dot) if len(t) else (self.empty, np.zeros(0, np.int64), np.zeros(0), 0)
        near = [(index.docs[e], float(c), float(index.toxic[e] / index.weight[e])) for e, c in zip(entry[:3].tolist(), cos[:3])]
        return float(np.clip(np.interp(raw, self.at, self.level), 0, 1)), near, scored


def label_z(which: np.ndarray, toxic: np.ndarray, n_terms: int, n: dict[int, int]) -> np.ndarray:
    """The two-sample z-score of each term's presence; `which` has a term once for each example, `toxic` its label."""
    a, c = np.bincount(which[toxic == 1], minlength=n_terms), np.bincount(which, minlength=n_terms)
    n1, n0 = max(n[1], 1), max(n[0], 1)
    p = c / (n1 + n0)
    return (a / n1 - (c - a) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))


EVIDENCE = "array<struct<doc_id:long,cosine:double,toxic:double>>"


def _scored(model, kept: list[str]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        own = model.value
        shape = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.float64())]))
        for batch in (whole.slice(lo, 16 * TOGETHER) for whole in batches for lo in range(0, whole.num_rows, 16 * TOGETHER)):
            found = [_terms(blob) for blob in batch.column("_terms").to_pylist()]
            out = list(own.scores([(t, unit((1 + np.log(n)) * own.term_weight[t])) for t, n in found]))
            evidence = pa.array([[{"doc_id": d, "cosine": c, "toxic": t} for d, c, t in e] for _, e, _ in out], shape)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([s for s, *_ in out], pa.float64()), evidence, pa.array([b for *_, b in out], pa.int32())], [*kept, "_score", "_evidence", "_blocks"])

    return run


def _voted(model) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            x, y, w = zip(*(v for v in model.value.own_votes(batch.column("id").to_pylist()))) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64()), pa.array(w, pa.float64())], ["x", "y", "w"])

    return run


def take_examples(rows: DataFrame, labels: DataFrame, id_col: str, max_examples: int, max_bytes: int) -> tuple[DataFrame, dict[int, int]]:
    """(_id, toxic, _text) of the examples, and the number of labelled ids of each label.

    Of each label, the smallest hashed ids, half of `max_examples` each if there are enough, up to half of `max_bytes` of
    text (one at least). Of rows that share an id, the one whose text has the smallest hash.
    """
    lab = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic")).where("_id IS NOT NULL")
    n = {y: 0 for y in (0, 1)} | {r["toxic"]: r["n"] for r in lab.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    half = max_examples // 2
    room = {y: min(n[y], max(half, max_examples - n[1 - y])) for y in (0, 1)}
    parts = [lab.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(room[y]) for y in (0, 1)]
    sample = cut(parts[0].union(parts[1]))
    text = F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t")))
    chosen = rows.join(F.broadcast(sample), "_id").groupBy("_id", "toxic").agg(text.alias("_s")).select("_id", "toxic", F.col("_s.t").alias("_text"))  # sample: at most max_examples rows
    before = Window.partitionBy("toxic").orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum(F.octet_length("_text")).over(before), F.lit(0))  # over at most max_examples rows
    return cut(chosen.withColumn("_filled", filled).where((F.col("_filled") == 0) | (F.col("_filled") + F.octet_length("_text") <= max_bytes // 2)).drop("_filled")), n


def toxicity_scores(docs: DataFrame, labels: DataFrame, columns: list[str], max_examples: int = 1_600, max_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row of `docs`, `columns` of it under the names c0, c1, ... with _score, _evidence and _blocks (scored for it)."""
    spark = docs.sparkSession
    ident, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sample, n = take_examples(docs.select(ident.alias("_id"), text.alias("_text")), labels, id_col, max_examples, max_bytes)
    seen = sample.mapInArrow(_terms_of, "_id long, toxic int, terms array<string>").toArrow().sort_by("_id")  # the words of at most max_bytes of text
    spread = seen.column("terms").combine_chunks()
    names = pc.unique(spread.flatten())
    names = names.take(pc.sort_indices(names))
    flat = pc.index_in(spread.flatten(), names).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(spread.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    found = [np.unique(x, return_counts=True) for x in np.split(flat, ends[:-1])] if len(ends) else []
    toxic = seen.column("toxic").to_numpy()
    took = {y: int((toxic == y).sum()) for y in (0, 1)}
    kept = [f"c{k}" for k in range(len(columns))]
    schema = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(columns, kept))
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(columns, kept)), text.alias("_text"))
    count = _counted(spark.sparkContext.broadcast(names), kept)
    once = text_col not in columns
    if once:  # then both passes read the counts of terms; else they read the texts, which are not written anew
        rows = cut(rows.mapInArrow(count, f"{schema}, _terms binary"))
    of = (lambda f: f) if once else (lambda f: lambda batches: f(count(batches)))  # one Python worker does both
    total, df = document_frequencies(rows, of(_frequencies(len(names))), len(names))
    z = label_z(np.concatenate([np.zeros(0, np.int64), *(t for t, _ in found)]), np.repeat(toxic, [len(t) for t, _ in found]), len(names), took)
    weight = (np.log((1 + total) / (1 + df)) + 1) * (np.abs(z) + FLOOR)
    scale = sum(took.values()) / max(sum(n.values()), 1)
    mass = {y: n[y] / max(took[y], 1) * scale for y in (0, 1)}
    model = Model(weight, [(i, t, c, int(y)) for i, (t, c), y in zip(seen.column("_id").to_pylist(), found, toxic)], mass)
    first = spark.sparkContext.broadcast(model)
    votes = spark.range(len(model.groups)).repartition(16).mapInArrow(_voted(first), "x double, y double, w double").collect()  # at most two an example
    model.calibrate([tuple(v) for v in votes])
    first.unpersist()
    return rows.mapInArrow(of(_scored(spark.sparkContext.broadcast(model), kept)), f"{schema}, _score double, _evidence {EVIDENCE}, _blocks int")


def score_toxicity(docs: DataFrame, labels: DataFrame, max_examples: int = 1_600, max_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id_col`, score, evidence) of every row.

    `labels` has `id_col` and toxic (0 or 1; anything else says nothing); all of it may be learned from. At most
    `max_examples` labelled documents are examples, of at most `max_bytes` of text: those of the smallest hashed ids,
    half of each label if there are enough. Every word of theirs is a term; a text's other words take no part. `evidence`
    has up to three nearest examples with cosine and label. Null and empty texts, and texts without a term, score as
    such examples do; without any labels, all score 0. Null ids have no labels but a score; repeated rows score alike;
    a document with both labels takes part with the higher one; of rows that share an id, one is the example.
    """
    out = toxicity_scores(docs, labels, [id_col], max_examples, max_bytes, id_col, text_col)
    return out.select(F.col("c0").cast("long").alias(id_col), F.col("_score").alias("score"), F.col("_evidence").alias("evidence"))


def drop_toxic_rows(docs: DataFrame, labels: DataFrame, least: float = 0.7, **options) -> DataFrame:
    """The rows of `docs`, all their columns, that score under `least`; each row is judged by its own text."""
    out = toxicity_scores(docs, labels, docs.columns, **options)
    return restored(out.where(F.col("_score") < least), docs, [f"c{k}" for k in range(len(docs.columns))])
