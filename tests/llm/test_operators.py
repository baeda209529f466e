"""Every operator against a brute-force version on a small fixture."""

import collections
import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from spikeframe.llm import line_dedup, queries, substring_dedup, suffix_dedup, topk, toxicity
from spikeframe.llm.bpe import Encoder, Vocabulary, encode_decode, merge_many, merge_one
from spikeframe.llm.components import connected_components
from spikeframe.llm.line_dedup import PerfectHash, dedup_lines
from spikeframe.llm.mixing import mix_sources
from spikeframe.llm.quality import RULES, STRATA, binomial_tail, certified, judge_quality, text_counts
from spikeframe.llm.simhash import simhash_components
from spikeframe.llm.substring_dedup import dedup_substrings
from spikeframe.llm.suffix_array import suffix_array
from spikeframe.llm.suffix_dedup import dedup_suffixes
from spikeframe.llm.topk import top_inner_products
from spikeframe.llm.toxicity import BlockMaxIndex, isotonic, score_toxicity
from spikeframe.llm.url_rules import judge_urls

from ..oracle import check

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
sha = lambda b: hashlib.sha256(b).hexdigest()


def rows(df, *cols, key="doc_id"):
    return {r[key]: tuple(r[c] for c in cols) for r in df.select(key, *cols).collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    check(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


# op1 -------------------------------------------------------------------------------------------------------------------


def brute_substrings(docs, width):
    seen, out = set(), {}
    for i, text in docs:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            w = tuple(words[k : k + width])
            if w in seen:
                gone[k : k + width] = [True] * width
            seen.add(w)
        kept = [w for w, g in zip(words, gone) if not g]
        out[i] = (len(words), len(words) - len(kept), sha(b" ".join(kept)))
    return out


@pytest.mark.parametrize("width", [1, 4, 20])
def test_substrings(docs, texts, width):
    want = brute_substrings(list(enumerate(texts)), width)
    found = dedup_substrings(docs, width)
    assert rows(found, "n_words", "n_removed", "kept_sha256") == want
    assert sum(w[1] for w in want.values()) > 0
    for r in found.where("n_removed > 0").collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["kept"].split()) == r["n_words"] - r["n_removed"]


def test_entries_grow_with_the_text_and_not_with_the_ranges():
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)) for _ in range(2500)]
    batch = pa.RecordBatch.from_pydict({"_id": pa.array(range(len(texts)), pa.int64()), "_th": pa.array([0] * len(texts), pa.int64()), "_text": pa.array(texts)})
    sent = lambda bits: sum(len(e) for b in substring_dedup._entries(20, bits, 16)(iter([batch])) for e in b.column("entries").to_pylist())
    # a task sorts SORTED windows at once; with fewer of them, proportionally fewer ranges give rows of the same size
    assert sent(11) <= 1.2 * sent(6)


def test_places_in_many_ranges_and_small_sorts(docs, texts, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RANGE", 20)
    want = brute_substrings(list(enumerate(texts)), 4)
    assert rows(dedup_substrings(docs, 4), "n_words", "n_removed", "kept_sha256") == want
    h = np.array([5, 5, 5, 1], np.uint64)
    first, late = substring_dedup.split_repeats(h, np.array([2, 1, 1, 9]), np.zeros(4, int), np.array([0, 7, 7, 3]))
    assert sorted(first.tolist()) in ([1, 3], [2, 3]) and late.tolist() == [0]


def test_substrings_odd(odd, nothing):
    assert dedup_substrings(nothing).count() == 0
    found = dedup_substrings(odd).select("doc_id", "n_words", "n_removed").collect()
    assert len(found) == 10
    got = collections.Counter(tuple(r) for r in found)
    # "some words" repeated: the first window of either phase stays, all others go; the null id comes first
    assert got[(None, 60, 58)] == 2 and got[(2, 60, 60)] == 2 and got[(2, 60, 58)] == 1 and got[(None, 0, 0)] == 1 and got[(1, 0, 0)] == 2 and got[(3, 1, 0)] == 1


# op2 -------------------------------------------------------------------------------------------------------------------


def brute_suffixes(docs, length):
    count = collections.Counter(b[k : k + length] for _, t in docs for b in [(t or "").encode()] for k in range(len(b) - length + 1))
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), len(b) - len(kept), spans, sha(kept))
    return out


@pytest.mark.parametrize("length, hot", [(64, 1000), (64, 3), (200, 1000), (200, 2)])
def test_suffixes(docs, texts, length, hot):
    found = dedup_suffixes(docs, length, hot=hot).withColumn("n_spans", F.size("spans"))
    assert rows(found, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_suffixes(list(enumerate(texts)), length)


def test_hot_grams_are_bounded(docs, texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_GRAMS", 3)
    found = dedup_suffixes(docs, 64, hot=2).withColumn("n_spans", F.size("spans"))
    assert rows(found, "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_suffixes(list(enumerate(texts)), 64)


def test_grams_fill_their_parts_alike():
    data = np.random.default_rng(5).integers(97, 123, 1 << 20).astype(np.uint8)
    gram, *_ = suffix_dedup.anchors(data, np.array([0, len(data)]), 200)
    share = np.bincount((gram >> np.uint64(58)).astype(np.int64), minlength=64) / len(gram)
    assert share.max() < 1.5 / 64


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n in [*range(30), 100, 1001]:
        for symbols in (1, 2, 5, 300):
            s = rng.integers(1, symbols + 1, n)
            assert suffix_array(s).tolist() == sorted(range(n), key=lambda i: s.tolist()[i:])


def test_suffixes_odd(odd, nothing):
    assert dedup_suffixes(nothing).count() == 0
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in dedup_suffixes(odd).collect())
    assert got == {(None, 0, 0): 1, (None, 330, 330): 2, (1, 0, 0): 2, (2, 330, 330): 2, (2, 360, 360): 1, (3, 200_000, 200_000): 1, (4, 360_000, 360_000): 1}
    with pytest.raises(ValueError):
        dedup_suffixes(odd, 10)


# op3 -------------------------------------------------------------------------------------------------------------------


def test_nearest_is_exact():
    rng = random.Random(2)
    vectors = []
    for _ in range(500):
        t = sorted(rng.sample(range(40), rng.randint(1, 6)))
        w = np.array([rng.random() for _ in t])
        vectors.append((np.array(t), w / np.linalg.norm(w)))
    index = BlockMaxIndex(vectors, np.zeros(500), np.ones(500), list(range(500)), 40)
    dense = np.zeros((500, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for _ in range(50):
        t = np.array(sorted(rng.sample(range(40), 3)))
        q = np.zeros(40)
        q[t] = np.array([0.5, 0.7, 0.5])
        entry, cos, _ = index.nearest(t, q[t], 10)
        want = np.sort(dense @ q)[::-1][:10]
        assert np.allclose(cos, want[want > 0]) and np.allclose((dense @ q)[entry], cos)


def test_blocks_that_cannot_reach_the_best_are_not_scored():
    entries = [(np.array([k // 64, 50 + k]), np.array([0.999, 0.0447])) for k in range(64 * 20)]
    index = BlockMaxIndex(entries, np.zeros(len(entries)), np.ones(len(entries)), list(range(len(entries))), 2000)
    entry, _, scored = index.nearest(np.array([3, 300]), np.array([0.9, 0.4]), 10)
    assert entry[0] == 250 and set(entry[1:]) <= set(range(192, 256)) and scored < index.blocks / 2


def brute_toxicity(docs, labels, k=25):
    """Scores of all documents: dense vectors, all cosines sorted, isotonic means by their min-max formula."""
    tf = {i: collections.Counter(toxicity.terms(t or "")) for i, t in docs}
    known = {i: y for i, y in labels.items() if i in tf}
    voc = sorted({w for i in known for w in tf[i]})
    n = {y: sum(v == y for v in known.values()) for y in (0, 1)}
    df = np.array([sum(w in c for c in tf.values()) for w in voc])
    a = np.array([sum(w in tf[i] for i in known if known[i]) for w in voc])
    c = np.array([sum(w in tf[i] for i in known) for w in voc])
    p = c / len(known)
    z = (a / n[1] - (c - a) / n[0]) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n[1] + 1 / n[0]))
    weight = (np.log((1 + len(tf)) / (1 + df)) + 1) * (abs(z) + 0.1)

    def vector(counter):
        v = np.array([(1 + np.log(counter[w])) if counter[w] else 0.0 for w in voc]) * weight
        return v / np.linalg.norm(v) if v.any() else v

    vec = {i: vector(tf[i]) for i in tf}
    groups = collections.defaultdict(list)
    for i in known:
        groups[tuple(sorted((w, m) for w, m in tf[i].items()))].append(i)
    none = groups.pop((), [])
    base = n[1] / len(known)
    empty = (sum(known[i] for i in none) + base) / (len(none) + 1)
    entries = [(vec[g[0]], g) for g in groups.values()]

    def vote(v, without=None):
        near = sorted(((float(e @ v), g) for e, g in entries), key=lambda x: -x[0])
        near = [x for x in near if x[0] > 0][: k + (without is not None)]
        toxic = sum(cos * (sum(known[i] for i in g) - (known[without] if without in g else 0)) for cos, g in near)
        every = sum(cos * (len(g) - (without in g)) for cos, g in near)
        return (toxic + 0.05 * base) / (every + 0.05)

    points = [(empty, empty, max(len(none), 1.0))] + [(vote(vec[i], i), known[i], 1.0) for i in known if i not in none]
    xs = sorted({round(x, 12) for x, _, _ in points})
    y = [sum(v * w for x, v, w in points if round(x, 12) == at) for at in xs]
    w = [sum(w for x, _, w in points if round(x, 12) == at) for at in xs]
    level = [max(min(sum(y[lo : hi + 1]) / sum(w[lo : hi + 1]) for hi in range(i, len(xs))) for lo in range(i + 1)) for i in range(len(xs))]
    return {i: float(np.interp(vote(vec[i]) if vec[i].any() else empty, xs, level)) for i in tf}


def test_whole_score_against_brute_force(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(150)]
    docs, labels = [], {}
    for i in range(120):
        bad = i % 4 == 0
        text = [rng.choice(words) for _ in range(rng.randint(5, 40))] + [rng.choice(["vile", "nastiest", "nastily"]) for _ in range(2 * bad)]
        rng.shuffle(text)
        docs.append((i, " ".join(text)))
        if i < 90:
            labels[i] = int(bad if rng.random() > 0.1 else not bad)
    docs += [(200, docs[3][1]), (201, None), (202, ""), (203, "123 !"), (204, "unseenword"), (205, docs[8][1])]
    labels |= {200: 1 - labels[3], 202: 0, 205: labels[8]}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    lab = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    want = brute_toxicity(docs, labels)
    got = {r["doc_id"]: r["score"] for r in score_toxicity(df, lab).collect()}
    assert got.keys() == want.keys() and len(set(got.values())) > 5
    assert max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_examples_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 10) for i in range(100)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i < 20)) for i in range(100)], "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    found, n = toxicity.take_examples(rows, lab, "doc_id", 40, 1 << 20)
    assert collections.Counter(r["toxic"] for r in found.collect()) == {0: 20, 1: 20} and n == {0: 80, 1: 20}
    assert 0 < toxicity.take_examples(rows, lab, "doc_id", 40, 400)[0].count() < 10


def test_isotonic():
    x, y = isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert np.interp([0, 1, 2, 3], x, y).tolist() == [0, 0.5, 0.5, 1]


def test_toxicity_held_out(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    data, labels = [], []
    for i in range(900):
        words, bad = [word() for _ in range(30)], i % 5 == 0
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(30), rng.choice(["vilebadx", "vilebady,", "Nasty!", "awful"]))
        data.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = rows(score_toxicity(docs, lab.where("doc_id < 600")), "score", "evidence")
    for i, y in labels:
        assert (found[i][0] >= 0.7) == bool(y)
    assert found[895][1] and found[895][1][0]["toxic"] == 1.0
    assert toxicity.terms("Nasty, vilebad1!") == ["nasty", "vilebad", "^vileb"]


def test_toxicity_odd(odd, nothing, spark):
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (4, 0), (5, None)], "doc_id long, toxic int")
    got = score_toxicity(odd, labels).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in score_toxicity(odd, labels.limit(0)).collect()} == {0.0}
    assert score_toxicity(nothing, labels).count() == 0


# op4 -------------------------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    rules = spark.createDataFrame(queries.URL_RULES + [("co", "/", "block", "co/"), ("a.com", "/e", "allow", "a.com/e"), ("a.com", "/en", "allow", "a.com/en")], "host string, path string, verdict string, rule string")
    urls = ["http://a.com/en/x", "http://x.a.com/en/", "http://ba.com/en/1", "https://EXAMPLE.com/en/7?q", "http://example.com/en/8#f", "http://com/en/", "http://com.x/en/", "http://xcom/en/", "no scheme/en/", None, "", "http://", "http://a.com?x=/en/", "ftp://u@n.net:80/de/8", "http://b.net/de/8", "http://example.net/de/8/9", "x://y://z.org/es/", "http://z.org/es/", "http://.com/en/", "http://com./en/"]
    pages = spark.createDataFrame([(i % 7 if i % 7 else None, u, 1, 2) for i, u in enumerate(urls)] * 2, "page_id long, url string, host int, rule int")
    by_rule = [r.asDict() for r in rules.collect()]

    def brute(url):
        if not url or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
        host = host.lower()
        fit = [r for r in by_rule if (host == r["host"] or host.endswith("." + r["host"])) and path.startswith(r["path"])]
        best = max(fit, key=lambda r: (len(r["host"] + r["path"]), len(r["host"]), r["verdict"]), default=None)
        return host, path, best and best["rule"], best["verdict"] if best else "allow"

    got = sorted(map(repr, (tuple(r) for r in judge_urls(pages, rules).collect())))
    assert got == sorted(repr((r["page_id"], *brute(r["url"]))) for r in pages.collect())
    assert judge_urls(pages.limit(0), rules).count() == 0
    plan = judge_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


# op5 -------------------------------------------------------------------------------------------------------------------


def test_mix_is_within_one_block(spark):
    data = [(i, s) for s, n in (("a", 500), ("b", 100), ("c", 37), (None, 60), ("d", 1)) for i in range(n)]
    docs = spark.createDataFrame([(k, s) for k, (_, s) in enumerate(data)], "doc_id long, source string")
    got = mix_sources(docs, slots=100, most=4.0).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(got)))
    n = collections.Counter(r["source"] for r in got)
    assert n == {"a": 240, "b": 100, "c": 37, None: 60, "d": 1}
    slots = sorted({(r["slot"], r["source"], r["block"]) for r in got}, key=lambda x: x[0])
    total = len(slots)
    assert [s for s, *_ in slots] == list(range(total))
    m, done = collections.Counter(s for _, s, _ in slots), collections.Counter()
    for t, (_, source, block) in enumerate(slots, 1):
        assert block == done[source]
        done[source] += 1
        for s in m:
            assert abs(done[s] - t * m[s] / total) < 1
    plan = mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_mix_to_given_weights(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(200)] + [(1000 + i, "c") for i in range(50)], "doc_id long, source string")
    weights = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 0.0), ("x", 1.0)], "source string, weight double")
    assert collections.Counter(r["source"] for r in mix_sources(docs, weights).collect()) == {"a": 100, "b": 50}


def test_mix_odd(odd, nothing):
    got = mix_sources(odd)
    assert got.count() == 10 and got.columns.count("slot") == 1
    assert mix_sources(nothing).count() == 0


# op6 -------------------------------------------------------------------------------------------------------------------


def brute_lines(docs, min_chars, min_docs):
    white = " \t\n\x0b\x0c\r"
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(white))
    held = collections.defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            held[lower(line)].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(k := lower(x)) < min_chars or len(held[k]) < min_docs or max(held[k]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("min_chars, min_docs, block", [(40, 5, 1 << 26), (10, 2, 1 << 26), (1, 2, 100)])
def test_lines(docs, texts, min_chars, min_docs, block, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    want = brute_lines(list(enumerate(texts)), min_chars, min_docs)
    assert rows(dedup_lines(docs, min_chars, min_docs, block_bytes=block), "n_lines", "n_dropped", "text") == want
    assert sum(w[1] for w in want.values()) > 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 2**63, 20_000).astype(np.uint64))
    place = PerfectHash(keys)
    assert np.array_equal(np.sort(place(keys)), np.arange(len(keys)))
    assert (place(keys + np.uint64(1)) < len(keys)).all() and not len(PerfectHash(keys[:0])(keys[:0]))


def test_lines_odd(odd, nothing):
    got = dedup_lines(odd, 1, 2)
    assert got.columns == [c for c in odd.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    n = collections.Counter((r["doc_id"], r["n_dropped"]) for r in got.collect())
    assert n == {(None, 0): 1, (None, 1): 2, (1, 0): 2, (2, 0): 3, (3, 0): 1, (4, 0): 1}
    assert dedup_lines(nothing).count() == 0


# op7 -------------------------------------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = random.Random(8)
    vec = lambda scale: [rng.uniform(-1, 1) * scale for _ in range(12)]
    data = [(i, vec(rng.choice((0.1, 1.0, 30.0)))) for i in range(3000)]
    data += [(3000 + i, data[7][1]) for i in range(40)]
    data += [(4000, None), (4001, [1.0, None]), (4002, [float("nan")] * 12), (4003, []), (4004, [1.0]), (None, vec(1)), (4020, [float("inf")] * 12), (4040, [1e300] * 12)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    queries_ = df.where("vec_id % 20 = 0")
    got = collections.defaultdict(list)
    for r in top_inner_products(df, queries_, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    import math

    ok = {i: [math.floor(64 * x) for x in v] + [0] * (12 - len(v)) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    for q in [i for i in ok if i % 20 == 0]:
        want = sorted(((-clip(sum(a * b for a, b in zip(ok[q], v))), i) for i, v in ok.items() if i != q))[:20]
        assert got.pop(q) == [(i, -s) for s, i in want]
    assert not got
    assert top_inner_products(df.limit(0), queries_.limit(0)).count() == 0


def test_lengths_and_coordinates_prune(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 32))
    x = x / np.linalg.norm(x, axis=1)[:, None] * rng.lognormal(0, 1.5, 4000)[:, None]
    x[:400] = x[7] * 1.5 + rng.normal(size=(400, 32)) * 0.05
    df = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)] + [(9, [0.0] * 32, 1, 2)], "vec_id long, embedding array<double>, id int, row int")
    ask = df.where("vec_id % 20 = 0")
    got = topk.searched(df, ask, 20, 64.0, "vec_id", "embedding").groupBy("query_id").agg(F.sum("verified").alias("n")).collect()
    assert len(got) == 200 and sum(r["n"] for r in got) < 0.3 * 200 * 4000
    v = np.floor(64 * x)
    want = {q: sorted(((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q))[:20] for q in range(0, 4000, 20)}
    found = collections.defaultdict(list)
    for r in top_inner_products(df, ask, 20).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((-r["score"], r["vec_id"]))
    assert found == want


# op8 -------------------------------------------------------------------------------------------------------------------


def test_bpe(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    got = rows(encode_decode(docs, VOCABULARY), "n_tokens", "ids", "decoded")
    for i, text in enumerate(texts):
        e = t.encode(text or "", add_special_tokens=False)
        assert got[i] == (len(e.ids), bytearray(np.array(e.ids, "<u4").tobytes()), t.decode(e.ids, skip_special_tokens=False))


def test_bpe_trees_agree():
    voc = Vocabulary.load(VOCABULARY)
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdethonig é1.") for _ in range(rng.randint(1, 40))).encode()[:60] for _ in range(500)]
    assert merge_many(words, voc) == [merge_one(w, voc) for w in words]
    enc = Encoder(voc)
    text = "word " * 3 + "x" * 5000 + " 漢字" * 200
    assert enc.decode(enc.encode([text])[0]) == text


def test_bpe_odd(odd, nothing):
    got = encode_decode(odd, VOCABULARY)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded"] and got.count() == 10
    assert got.where("n_tokens = 0 AND decoded = ''").count() == 3 and encode_decode(nothing, VOCABULARY).count() == 0


# op9 -------------------------------------------------------------------------------------------------------------------


def brute_counts(text, window=8):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    lines = [x for x in text.split("\n")]
    seen, dup = set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    wins = collections.defaultdict(list)
    for k in range(len(words) - window + 1):
        wins[tuple(words[k : k + window])].append(k)
    cover = {k + d for at in wins.values() if len(at) > 1 for k in at for d in range(window)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), dup, len(cover)


def test_counts(docs, texts):
    got = rows(text_counts(docs), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_binomial_bound():
    assert binomial_tail(0, 10, 0.5) == pytest.approx(0.5**10) and binomial_tail(10, 10, 0.5) == 1.0 and binomial_tail(5, 10, 0.5) == pytest.approx(0.623046875)
    assert certified([0, 0, 1, 200], 5000, 0.01, 0.001) == 3 and certified([0], 10, 0.01, 0.001) == 0 and certified([], 0, 0.1, 0.1) == 0


def test_quality_limits_false_rejections(spark):
    rng = random.Random(6)
    data, labels = [], []
    for i in range(9000):
        junk = i % 9 == 0
        data.append((i, " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) + ("###" if junk else "") for _ in range(40))))
        if i < 6000:
            labels.append((i, int(not junk)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(judge_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")), "kept", "base_failed")
    good = [i for i in range(6000, 9000) if i % 9]
    assert sum(not got[i][0] for i in good) <= 0.02 * len(good)
    assert not any(got[i][0] for i in range(6000, 9000) if not i % 9)
    kept = judge_quality(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert kept.where("kept = base_failed").count() == 0 and STRATA[0] == 20


def brute_verdicts(data, good, risk=0.02, delta=0.05):
    """kept of (id, text), the cutoffs being refitted by plain loops and whole numbers."""
    ratios = {"symbols": lambda c: (c[2], c[0]), "dup_lines": lambda c: (c[4], c[3]), "repeats": lambda c: (c[5], c[0]), "long_words": lambda c: (c[1], c[0])}
    counts = {i: brute_counts(t) for i, t in data}
    passes = {i: c[0] >= 20 and 100 * c[5] <= 30 * c[0] for i, c in counts.items()}
    stratum = {i: sum(c[0] >= s for s in STRATA[1:]) for i, c in counts.items()}
    share, level = Fraction(str(risk)) / len(ratios), Fraction(str(delta)) / (len(ratios) * len(STRATA))
    kept = dict(passes)
    for s in range(len(STRATA)):
        held = [i for i in good if passes[i] and stratum[i] == s]
        n = len(held)
        for name, ratio in ratios.items():
            cut = None
            for c in RULES[name][1]:
                k = sum(a / b > c for a, b in (ratio(counts[i]) for i in held))
                p, q = share.numerator, share.denominator
                tail = Fraction(sum(math.comb(n, j) * p**j * (q - p) ** (n - j) for j in range(k + 1)), q**n)
                if not n or k >= n * share or tail > level:
                    break
                cut = c
            for i in data if cut is not None else ():
                if stratum[i[0]] == s and passes[i[0]]:
                    a, b = ratio(counts[i[0]])
                    kept[i[0]] &= a / b <= cut
    return kept


def test_verdicts_against_refitted_cutoffs(spark):
    rng = random.Random(8)
    data = []
    for i in range(3600):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) + "#" * (rng.random() < 0.02) for _ in range(25 if i % 2 else 110)]
        at = rng.randrange(len(words))
        again = words[at : at + 8] if rng.random() < 0.05 else []
        data.append((i, " ".join([*words, *again]) + "\nsame line\nsame line" * (rng.random() < 0.01)))
    labels = [(i, int(rng.random() < 0.95)) for i in range(3600) if i % 9]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(judge_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")), "kept")
    expected = brute_verdicts(data, [i for i, q in labels if q])
    assert {i: k for i, (k,) in got.items()} == expected and 0 < sum(not k for k in expected.values()) < 1800


def test_quality_odd(odd, nothing, spark):
    labels = spark.createDataFrame([(2, 1), (2, None), (None, 1)], "doc_id long, quality int")
    got = collections.Counter((r["doc_id"], r["base_failed"], r["kept"]) for r in judge_quality(odd, labels).collect())
    assert got == {(None, True, False): 3, (1, True, False): 2, (2, True, False): 3, (3, True, False): 1, (4, True, False): 1}
    assert judge_quality(nothing, labels).count() == 0


# op10 ------------------------------------------------------------------------------------------------------------------


def brute_simhash(docs, k, limit):
    fp = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
    up = {i: i for i in fp}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(fp)
    for a in ids:
        for b in ids:
            if b < a and (fp[a] ^ fp[b]).bit_count() <= limit:
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (fp[i], top(i)) for i in ids}


@pytest.mark.parametrize("shingle, bits", [(4, 4), (5, 4), (1, 2), (2, 0)])
def test_simhash(docs, texts, shingle, bits):
    got = rows(simhash_components(docs, shingle, bits), "fp", "component_id")
    assert {i: (f % 2**64, c) for i, (f, c) in got.items()} == brute_simhash(list(enumerate(texts)), shingle, bits)


def test_more_tables_find_more(docs, texts):
    one, four = (rows(simhash_components(docs, 5, 4, tables=t), "component_id") for t in (1, 4))
    groups = collections.defaultdict(set)
    for i, c in one.items():
        groups[c].add(four[i])
    assert all(len(g) == 1 for g in groups.values()) and all(four[i] <= one[i] for i in one)
    fp = rows(simhash_components(docs, 5, 4, tables=4), "fp")
    assert {i: f[0] % 2**64 for i, f in fp.items()} == {i: f for i, (f, _) in brute_simhash(list(enumerate(texts)), 5, 4).items()}


def test_links_within_full_radius(spark, monkeypatch):
    from spikeframe.llm import simhash

    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in list(fps):
        g = f
        for b in rng.sample(range(64), rng.randint(1, 5)):
            g ^= 1 << b
        fps.append(g)
    fps = sorted({f - 2**64 if f >= 2**63 else f for f in fps})
    links = simhash.near_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"), 4)
    root = {r["node"]: r["root"] for r in connected_components(links).collect()}
    for a in fps:
        for b in fps:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4:
                assert root[a] == root[b]
    for r in links.collect():
        assert ((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 4
    # a range with too many words splits on further bits and gives the same links
    monkeypatch.setattr(simhash, "MOST", 500)
    small = simhash.near_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long"), 4)
    assert {r["node"]: r["root"] for r in connected_components(small).collect()} == root
    with pytest.raises(ValueError):
        simhash.near_fingerprints(small, 3)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(200 + i, 200) for i in range(1, 30)] + [(300, 300), (-5, -7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{200 + i: 200 for i in range(30)}, -5: -7, -7: -7}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_odd(odd, nothing):
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in simhash_components(odd).collect())
    assert got[(None, 1)] == 1 and got[(1, 1)] == 2 and got[(None, 2)] == 2 and got[(2, 2)] >= 2 and sum(got.values()) == 10
    assert simhash_components(nothing).count() == 0
