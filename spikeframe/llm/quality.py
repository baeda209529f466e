"""Quality rules with risk-controlled thresholds.

Every document gets counts (words, symbols, repeated lines, repeated word windows). A rule rejects what exceeds a cutoff
on one ratio. Cutoffs stand on fixed grids, laxest first; on labelled good documents that no fit has seen, the exact
binomial tail tests for each (stratum, rule) whether a cutoff rejects more than its share of the risk. Cutoffs are tried
in order until the first that can't be certified (fixed-sequence testing, so their number costs nothing); strata and
rules share the error level (Bonferroni). With probability 1 - delta, no stratum loses more than `risk` of its good
documents to the rules. A stratum with too few labels certifies nothing and keeps all that passes the base.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import IS_WHITE, byte_column, cut, mix, pieces, span_hash, window_hash, word_spans

CHUNK = 4 << 20
#: Strata: documents of at least so many words.
STRATA = (20, 100, 400, 1600)
#: Ratio of each rule and its cutoffs, laxest first.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", tuple(8.0 * 0.85**i for i in range(40))),
    "dup_lines": ("n_dup_lines / n_lines", tuple(1.0 - 0.025 * i for i in range(1, 40))),
    "repeats": ("n_repeat_words / n_words", tuple(0.3 - 0.0075 * i for i in range(40))),
    "long_words": ("word_chars / n_words", tuple(40.0 * 0.95**i for i in range(40))),
}
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _first(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the entries by (document, hash), and which of them in that order are the first of their kind."""
    key = mix(h ^ mix(doc.astype(np.uint64) + np.uint64(1)))
    by = np.argsort(key, kind="stable")
    new = np.ones(len(by), bool)
    new[1:] = key[by][1:] != key[by][:-1]
    return by, new


def _counts(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", CHUNK):
            data, offsets = byte_column(piece.column("_text"))
            docs = len(offsets) - 1
            starts, ends, first = word_spans(data, offsets)

            def per_doc(flag: np.ndarray) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
                return sums[offsets[1:]] - sums[offsets[:-1]]

            chars = per_doc(~IS_WHITE[data] & ((data & 0xC0) != 0x80))
            symbols = per_doc(SYMBOL[data])
            # lines: from a text's start or behind a line feed, up to a line feed or the text's end
            feeds = np.flatnonzero(data == 10)
            begin = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
            end = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
            n_lines = np.searchsorted(feeds, offsets[1:]) - np.searchsorted(feeds, offsets[:-1]) + 1
            of_line = np.repeat(np.arange(docs), n_lines)
            # behind a final line feed stands the empty last line, which sorts to where the next text starts
            wordy = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
            b, e, d = begin[wordy], end[wordy], of_line[wordy]
            by, new = _first(d, span_hash(data, b, e))
            dup_lines = np.bincount(d[by][~new], minlength=docs)
            # windows
            h = window_hash(span_hash(data, starts, ends), window)
            doc = np.repeat(np.arange(docs), np.diff(first))
            at = np.flatnonzero(np.arange(len(h)) + window <= first[1:][doc[: len(h)]])
            by, new = _first(doc[at], h[at])
            again = ~new
            again[:-1] |= ~new[1:]
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, at[by][again], 1)
            np.add.at(cover, at[by][again] + window, -1)
            covered = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
            repeat = covered[first[1:]] - covered[first[:-1]]
            yield pa.RecordBatch.from_arrays([piece.column("_id"), *(pa.array(x.astype(np.int64)) for x in (np.diff(first), chars, symbols, n_lines, dup_lines, repeat))], ["_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"])

    return run


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8) -> DataFrame:
    """`id_col` and the counts of every row's text; null: no words, one empty line."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    out = rows.mapInArrow(_counts(window), "_id long, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    return out.withColumnRenamed("_id", id_col)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial X, exactly summed."""
    if k >= n:
        return 1.0
    at = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    return min(1.0, math.fsum(at(i) for i in range(k + 1)))


def certified(rejected: list[int], n: int, risk: float, level: float) -> int:
    """How many cutoffs, laxest first, reject more than `risk` of good documents with probability `level` at most."""
    for i, k in enumerate(rejected):
        if not n or k >= n * risk or binomial_tail(k, n, risk) > level:
            return i
    return len(rejected)


def stratum(n_words: Column) -> Column:
    return sum(((n_words >= s).cast("int") for s in STRATA[1:]), F.lit(0))


def fit_cutoffs(counts: DataFrame, labels: DataFrame, risk: float, delta: float, id_col: str = "doc_id") -> dict[tuple[int, str], float]:
    """The strictest certified cutoff of each (stratum, rule). The driver gets one row a stratum."""
    good = labels.groupBy(F.col(id_col).alias("_l")).agg(F.min("quality").alias("q")).where("q = 1")
    held = counts.where(~F.col("base_failed")).join(good, F.col(id_col) == F.col("_l"), "left_semi")
    sums = [F.sum((F.expr(ratio) > c).cast("long")).alias(f"{name}_{i}") for name, (ratio, cuts) in RULES.items() for i, c in enumerate(cuts)]
    level, share = delta / (len(STRATA) * len(RULES)), risk / len(RULES)
    out = {}
    for row in held.groupBy(stratum(F.col("n_words")).alias("s")).agg(F.count("*").alias("n"), *sums).collect():
        for name, (_, cuts) in RULES.items():
            if m := certified([row[f"{name}_{i}"] for i in range(len(cuts))], row["n"], share, level):
                out[row["s"], name] = cuts[m - 1]
    return out


def judge_quality(docs: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, the counts, base_failed, kept and failed (names of the rules) of every row.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word windows. `labels` has `id_col` and
    quality (1: good); a document is good if all its labels say so; null labels say nothing. Without labels, no rule has
    a cutoff. Null and empty texts fail the base; null ids have no labels; repeated rows are judged alike.
    """
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = cut(text_counts(docs, id_col, text_col).withColumn("base_failed", base))
    cutoffs = fit_cutoffs(counts, labels, risk, delta, id_col)
    s = stratum(F.col("n_words"))
    fails = [F.when((s == k) & (F.expr(RULES[name][0]) > c), F.lit(name)) for (k, name), c in sorted(cutoffs.items())]
    failed = F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(F.array_distinct(F.array_compact(F.array(*fails))) if fails else F.array().cast("array<string>"))
    return counts.withColumn("failed", failed).withColumn("kept", F.size("failed") == 0)
