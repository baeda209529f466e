"""Many columns of queries: blocks are sent to the columns that ask for them, and no answer is lost."""

import numpy as np

from spikeframe.llm import topk


def by_force(vectors, asked, k):
    out = {}
    ids, x = np.array([i for i, _ in vectors]), np.floor(64 * np.array([v for _, v in vectors])).astype(np.int64)
    for q, v in asked:
        score = x @ np.floor(64 * np.array(v)).astype(np.int64)
        best = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if i != q)[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def test_columns_and_blocks_of_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 20)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 60)
    monkeypatch.setattr(topk, "SEEDS", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 12)) * np.exp(rng.normal(size=(1500, 1)) * 1.5)
    x[1200:] = x[7]  # a third of the rows are copies
    x[5] = 0
    vectors = [(k, v.tolist()) for k, v in enumerate(x)]
    asked = vectors[::7]
    schema = "vec_id long, embedding array<double>"
    df, ask = spark.createDataFrame(vectors, schema), spark.createDataFrame(asked, schema)
    got: dict = {}
    for r in topk.top_inner_products(df, ask, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == by_force(vectors, asked, 5)
    plan = topk.searched(df, ask, 5, 64.0, "vec_id", "embedding")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # queries of long vectors need the longest blocks only: fewer pairs of blocks than all
    work = topk.searched(df, ask, 5, 64.0, "vec_id", "embedding").groupBy("query_id").agg({"verified": "sum"}).collect()
    assert sum(r[1] for r in work) < 0.8 * len(asked) * len(vectors)
