"""Phrase collocations: words that stand together more often than their parts explain.

Texts are split into pieces and words, and all phrases of 1 to n words are exploded into rows and counted by language. A
phrase is scored by its count, squared, over the counts of its two parts, at the cut that makes the score lowest. A phrase
goes if one longer by a word keeps most of its occurrences; the rest are ranked.

A phrase with fewer occurrences than `min_count` has no use beyond the total of words: it is no candidate, no part of one
and extends none. Since a phrase occurs no more often than its parts, phrases of n words are exploded only where both
their parts of n - 1 words are frequent. Tasks know frequent phrases from a bitmap of fixed size that loses none and, with
ever more of them, lets ever more others pass; whatever passes is counted by its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BASE, LOWER, UPPER, cut, mix, pieces, span_hash

#: A-Z are lower-cased; what separates pieces becomes a line feed, a tab a space.
LINES = bytes.maketrans(UPPER.encode() + b".,;:!?\x0b\x0c\r\t", LOWER.encode() + b"\n" * 9 + b" ")
CHUNK, RUN, HELD = 2 << 20, 4 << 20, 300_000
#: Bits of the map of frequent phrases: 16 MB.
BITS = 27


def runs(data: bytes, n: int, limit: int) -> Iterator[bytes]:
    """The same bytes in runs of about `limit` that end between words; each begins with the last n - 1 words of the one before."""
    lo, size = 0, limit
    while len(data) - lo > size:
        ends = [e for e in (data.find(b" ", lo + size), data.find(b"\n", lo + size)) if e >= 0]
        if not ends:
            break
        hi = back = min(ends)
        for _ in range(n - 1):
            while back > lo and data[back - 1] in b" \n":
                back -= 1
            while back > lo and data[back - 1] not in b" \n":
                back -= 1
        if back <= lo:  # too few words: a longer run
            size *= 2
            continue
        yield data[lo:hi]
        lo, size = back, limit
    yield data[lo:]


def language_seed(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode(), np.uint8)
    return span_hash(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0] if len(raw) else np.uint64(1)


def phrases(data: bytes, lang: str, n: int, frequent: np.ndarray | None) -> tuple[pa.Array, np.ndarray, int]:
    """All phrases of n words in a run of lines whose parts of n - 1 words may be frequent, their hashes, and the number of words."""
    raw = np.frombuffer(data + b"\n", np.uint8)
    line = raw == 10
    inside = ~line & (raw != 32)
    behind = np.zeros(len(raw), bool)
    behind[1:] = inside[:-1]
    starts, ends = np.flatnonzero(inside & ~behind), np.flatnonzero(~inside & behind)
    words = len(starts)
    if words < n:
        return pa.array([], pa.binary()), np.zeros(0, np.uint64), words
    # one separator behind each word: what is left of the run
    kept = inside | behind
    at = np.cumsum(kept)
    text, begin, end = raw[kept], at[starts] - 1, at[ends] - 1
    of_line = np.cumsum(line)[starts]
    one = span_hash(raw, starts, ends) ^ language_seed(lang)
    here, h = np.arange(words), mix(one)
    for k in range(1, n):  # h: phrases of k words from each place in `here`
        some = (frequent[h >> np.uint64(64 - BITS + 3)] >> ((h >> np.uint64(64 - BITS)) & np.uint64(7)).astype(np.uint8)) & 1 == 1 if k == n - 1 else np.ones(len(h), bool)
        hits = np.zeros(words + 1, bool)
        hits[here[some]] = True
        full = np.zeros(words, np.uint64)
        full[here] = h
        here = here[hits[here] & hits[here + 1] & (here + k < words)]
        here = here[of_line[here] == of_line[here + k]]
        h = mix(full[here] * np.uint64(BASE) + one[here + k])
    size = end[here + n - 1] - begin[here]
    offsets = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(offsets[-1]) + np.repeat(begin[here] - offsets[:-1], size)
    out = pa.Array.from_buffers(pa.binary(), len(here), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text[index])])
    return out, h, words


def _counted(n: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (lang, phrase, n), pre-aggregated; for single words, a row (lang, null, n) holds the words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value if shared else None
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])

        for piece in pieces(batches, "text", CHUNK):
            langs = piece.column("lang")
            for lang in pc.unique(langs).to_pylist():
                own = piece.filter(pc.equal(langs, lang)).column("text").to_pylist()
                for data in runs("\n".join(own).encode().translate(LINES), n, RUN):
                    found, _, words = phrases(data, lang, n, frequent)
                    kinds = found.value_counts()
                    texts, counts = kinds.field("values"), kinds.field("counts")
                    if n == 1 and words:
                        texts, counts = pa.concat_arrays([texts, pa.nulls(1, pa.binary())]), pa.concat_arrays([counts, pa.array([words], pa.int64())])
                    held.append(pa.table({"lang": pa.array([lang] * len(texts), pa.string()), "phrase": texts, "n": counts}))
            if sum(t.num_rows for t in held) > HELD:
                held = [merged()]
                if held[0].num_rows > HELD // 2:
                    yield from out(held.pop())
        if held:
            yield from out(merged())

    def out(t: pa.Table) -> list[pa.RecordBatch]:
        return t.set_column(1, "phrase", t.column("phrase").cast(pa.string())).to_batches(max_chunksize=50_000)

    return run


def _bits(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Positions in the map of frequent phrases, for rows of counted phrases of n words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everything = np.full(1 << BITS - 3, 255, np.uint8)
        for batch in batches:
            langs, texts = batch.column("lang"), batch.column("phrase")
            for lang in pc.unique(langs).to_pylist():
                own = texts.filter(pc.equal(langs, lang)).to_pylist()
                _, h, _ = phrases("\n".join(own).encode(), lang, n, everything)
                yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - BITS)).astype(np.int64))], ["bit"])

    return run


def frequent_map(counts: DataFrame, n: int):
    """The broadcast map of the phrases in `counts`, all of n words: of fixed size, gathered from parts of 4 KB."""
    spot = F.col("bit") + 1  # bucket 0 would hold the position 0 alone
    maps = counts.select("lang", "phrase").mapInArrow(_bits(n), "bit long").select(F.bitmap_bucket_number(spot).alias("b"), F.bitmap_bit_position(spot).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("map"))
    bits = np.zeros(1 << BITS - 3, np.uint8)
    for r in maps.toLocalIterator():  # at most 2^BITS / 32768 rows
        # positions count from the first bit of a part; part b covers (b - 1) * 32768 + 1 to b * 32768
        bits[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["map"], np.uint8)
    return counts.sparkSession.sparkContext.broadcast(bits)


def phrase_counts(docs: DataFrame, max_words: int, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of the phrases with at least `min_count` occurrences, and (lang, total) of all words. `docs`: lang, text."""
    levels, shared, total = [], None, None
    for n in range(1, max_words + 1):
        counts = docs.mapInArrow(_counted(n, shared), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        counts = cut(counts.where(F.col("phrase").isNull() | (F.col("f") >= min_count)))
        if n == 1:
            total = counts.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("total"))
            counts = counts.where(F.col("phrase").isNotNull())
        levels.append(counts.select("lang", F.lit(n).alias("words"), "phrase", "f"))
        if n < max_words:
            shared = frequent_map(counts, n)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, total


def first_words(phrase: str, k: str) -> Column:
    return F.expr(f"substring_index({phrase}, ' ', {k})")


def scored(counts: DataFrame, max_words: int) -> DataFrame:
    """lang, phrase, words, a, l, r, score of every candidate at its lowest-scoring cut; ties go to the first."""
    some = counts.where("words > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    some = some.select("lang", "words", "phrase", F.col("f").alias("a"), "k", first_words("phrase", "k").alias("left"), first_words("phrase", "k - words").alias("right"))
    lefts = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = some.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    # exact: counts have up to 15 digits, the products up to 37
    exact = "(cast(a AS decimal(15, 0)) * cast(a AS decimal(15, 0)) * 1000000BD) div (cast(l AS decimal(15, 0)) * cast(r AS decimal(15, 0)))"
    cuts = cuts.withColumn("score", F.expr(exact))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(best).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def extended(counts: DataFrame) -> DataFrame:
    """lang, phrase, longest: the highest count of the phrases that are longer by one word at either end."""
    longer = counts.where("words > 2")
    parts = F.explode(F.array(first_words("phrase", "words - 1"), first_words("phrase", "1 - words")))
    return longer.select("lang", parts.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, covered: int = 50, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the `most` best phrases of each language.

    A phrase of 2 to `max_words` words with a >= `min_count` occurrences is a candidate. It goes if a candidate longer by a
    word holds it and has `covered` per cent of its occurrences; that a still longer one does implies it. l and r count its
    parts at the cut with the lowest score floor(10^6 * a * a / (l * r)), n all words of the language. Ranks go by score, a,
    and phrase in byte order. Null texts are empty, null languages `und`; repeated rows are counted each; an empty table
    gives no rows; other columns are left aside. Texts are taken in runs of some megabytes,
    so that a long one costs only time.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have two words or more, and occur")
    docs = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    counts, total = phrase_counts(docs, max_words, min_count)
    gone = extended(counts)
    kept = scored(counts, max_words).join(gone, ["lang", "phrase"], "left").where(F.expr(f"longest IS NULL OR 100 * longest < {covered} * a")).drop("longest")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each part of a language first, so that no task ranks a whole language
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    ahead = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most)
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
