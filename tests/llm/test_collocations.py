"""Phrase collocations against plain loops."""

import collections
import re

import pytest

from spikeframe.llm import collocations as module
from spikeframe.llm.collocations import LINES, collocations, runs


def brute(rows, max_words, min_count, covered, most):
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, max_words + 1):
                count[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in count.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        inside = collections.Counter()
        for p, a in cands.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside[p[i : i + n]], a)
        kept = []
        for p, a in cands.items():
            if p not in inside or 100 * inside[p] < covered * a:
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:most]):
            out.append((lang, rank + 1, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("max_words", "min_count", "covered", "most"), [(3, 2, 50, 2000), (2, 3, 50, 10), (4, 2, 90, 50), (3, 1, 100, 7)])
def test_equals_plain_loops(spark, texts, max_words, min_count, covered, most):
    rows = [(t, "ab"[i % 2] if i % 7 else None) for i, t in enumerate(texts)]
    rows += [("New York; new  york\tCity, of NEW\x0byork. é x é x!", "a")] * 3 + [("und so", "und"), ("und so", ""), ("only,", "c")]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    want = brute(rows, max_words, min_count, covered, most)
    assert len(want) > 5 and found(collocations(df, max_words, min_count, covered, most)) == want


def test_odd_rows(spark, odd, nothing):
    rows = [(r["text"], None if r["lang"] is None else str(r["lang"])) for r in odd.collect()]
    assert found(collocations(odd, 3, 2)) == brute(rows, 3, 2, 50, 2000)
    assert collocations(nothing).count() == 0


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("l", 1, "x", 10**13), ("l", 1, "y", 10**13 - 1), ("l", 2, "x y", 10**13 - 7)], "lang string, words int, phrase string, f long")
    r = module.scored(counts, 2).first()
    assert r["score"] == 10**6 * (10**13 - 7) ** 2 // (10**13 * (10**13 - 1))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_runs_hold_every_phrase_once(n):
    text = "\n".join(" ".join(f"w{i * i % 97}x{j}" for j in range(i % 9)) for i in range(400)) + "z" * 900 + " a b c\n\n d"
    grams = lambda data: collections.Counter(tuple(w[i : i + n]) for w in map(str.split, data.split("\n")) for i in range(len(w) - n + 1))
    split = sum((grams(r.decode()) for r in runs(text.encode(), n, 50)), collections.Counter())
    assert split == grams(text)
    assert sum(1 for _ in runs(text.encode(), n, 50)) > 20


def test_a_full_map_only_lets_more_pass(spark, texts, monkeypatch):
    """With every bit set, as with very many frequent phrases, the rows are the same."""
    rows = [(t, "a") for t in texts]
    df = spark.createDataFrame(rows, "text string, lang string")
    import numpy as np

    monkeypatch.setattr(module, "frequent_map", lambda counts, n: counts.sparkSession.sparkContext.broadcast(np.full(1 << module.BITS - 3, 255, np.uint8)))
    assert found(collocations(df, 3, 2)) == brute(rows, 3, 2, 50, 2000)


def test_separators():
    assert "A.b\tC\x0bd\x00".encode().translate(LINES) == b"a\nb c\nd\x00"
