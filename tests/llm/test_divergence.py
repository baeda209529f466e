"""The audit of sources against plain loops."""

import collections
import re

import pytest

from spikeframe.llm import divergence
from spikeframe.llm.divergence import audit_sources, bucket, runs

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs, k):
    """rows of (text, lang, source)."""
    docs = collections.defaultdict(lambda: collections.defaultdict(int))
    count = collections.defaultdict(collections.Counter)
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        count[lang, source].update(terms)
        for t in set(terms):
            docs[lang][t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = {s: {t: count[lang, s][t] for t in kept} for l, s in groups if l == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q = share(whole)
        for s, c in own.items():
            p = share(c)
            pairs = []
            for o, d in own.items():
                if o != s:
                    r = share(d)
                    pairs.append((sum(abs(p[t] - r[t]) for t in kept), o))
            terms = [(p[t] - q[t], t) for t in kept if c[t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, k)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(order)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("min_docs", "k"), [(2, 3), (1, 1000), (8, 5), (10_000, 5)])
def test_equals_plain_loops(spark, texts, min_docs, k):
    rows = [(t, "ab"[i % 2] if i % 7 else None, f"s{i * i % 5}" if i % 11 else None) for i, t in enumerate(texts)] + [("12 34", "a", "digits"), (None, "none", "x"), ("", "none", "y")]
    rows += [("Über über ÜBER x1y x_y the the the", "a", "s1")] * 9
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    want = brute(rows, min_docs, k)
    assert found(audit_sources(df, min_docs, k)) == want and any(r[2] == "pair" for r in want)


def test_ties_and_many_rounds(spark, monkeypatch):
    """Hundreds of terms of equal worth: closed buckets that equal the k-th term are opened, and ties go by the item's bytes."""
    words = [f"{c}{d}" for c in "abcdefghijklmnopqrst" for d in "zyxwvutsrqponmlkj"] + ["é", "日"]
    rows = [(" ".join(words), "l", "one")] * 3 + [(" ".join(words[:200] * 2), "l", "two")] * 2 + [("aa bb " * 40, "l", "three")] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert found(audit_sources(df, 1, 4)) == brute(rows, 1, 4)


def test_odd_rows(spark, odd, nothing):
    rows = [(r["text"], None if r["lang"] is None else str(r["lang"]), r["source"]) for r in odd.collect()]
    assert found(audit_sources(odd, 1, 5)) == brute(rows, 1, 5)
    assert audit_sources(nothing).count() == 0


def test_runs_cut_no_word(monkeypatch):
    data = b"aaa bb " * 1000 + b"c" * 5000 + b" d"
    assert b"".join(runs(data, 64)) == data
    assert sum((r.split() for r in runs(data, 64)), []) == data.split()


def test_buckets_hold_nearly_equal_counts(spark):
    got = {r["c"]: r["b"] for r in spark.range(1, 5000).select(divergence.F.col("id").alias("c")).withColumn("b", bucket("c")).collect()}
    assert all(got[c] <= got[c + 1] for c in range(1, 4999)) and len({got[c] for c in range(1, 32)}) == 31
    ends = collections.defaultdict(list)
    for c, b in got.items():
        ends[b].append(c)
    assert all(max(v) <= min(v) * 17 / 16 for v in ends.values())
