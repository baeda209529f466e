"""Audit of how the sources of a language diverge in their terms.

Terms are counted by (language, source) and kept if enough documents of the language have them. Smoothed shares are whole
numbers, so all sums are exact.

Distances of sources come from postings: a term that two sources lack adds the distance of their shares of nothing, so the
sum over all terms is that distance for every term, put right for the terms that either has; only terms that both have are
met by a join of postings.

The terms that set a source apart are found by an upper-bound search: the terms of a group stand in buckets of nearly equal
counts, each with its largest share and the least share that the language gives to any of its terms. The difference
bounds the bucket. Buckets are opened best first until what is closed is bounded strictly below the k-th best term found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, cut, pieces

#: A term is a run of letters and of characters beyond ASCII; only A-Z are lower-cased. The rest separates terms.
TERM_BYTES = bytes.maketrans(UPPER.encode() + bytes(b for b in range(128) if not chr(b).isalpha()), LOWER.encode() + b" " * (128 - 52))
CHUNK, RUN, HELD = 4 << 20, 8 << 20, 200_000
#: Rows that share a group are dealt to so many tasks.
SALTS = 16


def runs(data: bytes, limit: int = RUN) -> Iterator[bytes]:
    """The same bytes in runs of about `limit` that end before a space, so that no word is cut."""
    lo = 0
    while len(data) - lo > limit:
        hi = data.find(b" ", lo + limit)
        if hi < 0:
            break
        yield data[lo:hi]
        lo = hi
    yield data[lo:]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            cols = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "term", "n", "docs"])
        counts.clear()

    for piece in pieces(batches, "text", CHUNK):
        for lang, source, text in zip(*(piece.column(c).to_pylist() for c in ("lang", "source", "text"))):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for run in runs(text.encode().translate(TERM_BYTES)):
                words = run.split()
                n.update(words)
                own.update(words)
            docs.update(own)
        if sum(len(n) for n, _ in counts.values()) > HELD:
            yield from flush()
    yield from flush()


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)) of named columns, in whole numbers; 0 without terms. Counts below 10^18."""
    over = f"cast({total} + 5 * {terms} AS decimal(20, 0))"
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + (cast({count} + 5 AS decimal(19, 0)) * 1000000000BD) div {over} ELSE 0L END")


def spread(rows: DataFrame) -> DataFrame:
    """Every row once for each salt."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def salted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, source, term, c: occurrences of each kept term in each group that has it; lang_c: in the language; one: true in one row a term."""
    rows = docs.mapInArrow(_term_counts, "lang string, source string, term string, n long, docs long")
    counts = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("c"), F.sum("docs").alias("d"))
    of_term = Window.partitionBy("lang", "term")  # as many rows as the language has sources, at most
    whole = counts.select("lang", "source", "term", "c", F.sum("d").over(of_term).alias("d"), F.sum("c").over(of_term).alias("lang_c"), (F.min("source").over(of_term) == F.col("source")).alias("one"))
    return whole.where(F.col("d") >= min_docs).drop("d")


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n: occurrences of kept terms; v, lang_n: kept terms and their occurrences in the language; z: the share of a term that the group lacks."""
    sums = kept.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    langs = kept.groupBy("lang").agg(F.sum(F.col("one").cast("long")).alias("v"), F.sum("c").alias("lang_n"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    return groups.withColumn("nothing", F.lit(0).cast("long")).withColumn("z", share("nothing", "n", "v")).drop("nothing")


def distances(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the distance of every two sources of a language, both ways."""
    pair = [F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")]
    own = postings.groupBy("lang", "source").agg(F.count("*").alias("k"), F.sum("p").alias("ps"))
    ends = groups.join(own, ["lang", "source"], "left").fillna(0, ["k", "ps"])
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"))
    both = ends.join(other, "lang").where("source <> item")
    apart = F.abs(F.col("z") - F.col("other_z"))
    # all terms, as if both lacked them (once a pair, hence from the lesser); then the source's own terms, as if their shares were above other_z
    far = both.select("lang", *pair, (F.when(F.col("source") < F.col("item"), F.col("v") * apart).otherwise(0) + F.col("ps") - F.col("k") * F.col("other_z") - F.col("k") * apart).alias("value"))
    # put right where they are below
    top = groups.groupBy("lang").agg(F.max("z").alias("top_z"))
    low = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("k")).join(top, "lang").where("p < top_z")
    low = salted(low, "source", "p").join(spread(other), ["lang", "salt"]).where("source <> item AND p < other_z")
    low = low.groupBy("lang", *pair).agg(F.sum(2 * F.col("k") * (F.col("other_z") - F.col("p"))).alias("value"))
    # and where both have the term
    a = postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    b = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    met = a.join(b, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(F.expr("abs(pa - pb) - abs(pa - zb) - abs(za - pb) + abs(za - zb)")).alias("value"))
    sums = far.unionByName(low).unionByName(met).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    way = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", way.alias("way"), "value").select("lang", "way.source", "way.item", "value")


def bucket(count: str) -> Column:
    """Counts of up to 31 have a bucket each; above, a bucket spans a sixteenth of the way to the next power of two, at most."""
    return F.expr(f"greatest(length(bin({count})) - 5, 0) * 32L + shiftright({count}, greatest(length(bin({count})) - 5, 0))")


def first_of(rows: DataFrame, k: int | None) -> DataFrame:
    """rank of the rows of a group by value, falling, and item; only the first k."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def setting_apart(postings: DataFrame, k: int, growth: int = 8) -> DataFrame:
    """lang, source, item, value, rank: the k terms whose share in the source exceeds the language's most."""
    terms = postings.withColumn("bucket", bucket("c"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = terms.groupBy("lang", "source", "bucket").agg(F.count("*").alias("n"), (F.max("p") - F.min("q")).alias("bound")).where("bound > 0")
    bounds = cut(bounds.withColumn("before", F.coalesce(F.sum("n").over(best), F.lit(0))))
    top, closed, upper = None, bounds, k
    while True:
        opened = spread(closed.where(F.col("before") < upper).select("lang", "source", "bucket"))
        # the salted keys meet each row of an opened bucket once
        found = salted(terms, "term").join(opened, ["lang", "source", "bucket", "salt"], "left_semi").where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        top = cut(first_of(found if top is None else found.unionByName(top.drop("rank")), k))
        kth = top.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
        closed = bounds.where(F.col("before") >= upper).join(kth, ["lang", "source"], "left").where("kth IS NULL OR bound >= kth").drop("kth")
        if closed.isEmpty():
            return top
        upper *= growth


def audit_sources(docs: DataFrame, min_docs: int = 30, k: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: for every (language, source), its distance to each other source of the language
    (part `pair`) and the k terms that set it apart from the language (part `term`).

    A term counts if `min_docs` rows of the language have it; repeated rows are rows of their own. Null texts, languages and
    sources are empty strings. A group without terms has distances; without kept terms in the language they are 0. An empty
    table gives no rows; other columns are left aside. A text is taken in runs of some megabytes, so its length costs only
    time, but for its distinct terms.
    """
    names = {"text": text_col, "lang": lang_col, "source": source_col}
    docs = docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for n, c in names.items()))
    kept = cut(kept_terms(docs, min_docs))
    groups = cut(group_sizes(docs, kept))
    postings = salted(kept, "term").join(spread(groups), ["lang", "source", "salt"])
    postings = cut(postings.select("lang", "source", "term", "c", "z", share("c", "n", "v").alias("p"), share("lang_c", "lang_n", "v").alias("q")))
    pairs = first_of(distances(postings, groups), None).withColumn("part", F.lit("pair"))
    terms = setting_apart(postings, k).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
