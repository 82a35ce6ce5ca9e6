import math

import numpy as np
import pytest

from semblance.llm import ann as A

SMALL = "/root/testdata/sf0.01"


def brute(rows, k=20, every=20):
    """``{query: [(vec_id, score)]}`` by all inner products."""
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], dtype=float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        scores = A.inner_products(np.repeat(vectors[q:q + 1], len(ids), axis=0), vectors)
        ranked = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != ids[q])
        out[int(ids[q])] = [(i, -s) for s, i in ranked[:k]]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("freedom, share, value", [(8, 0.99, 20.09), (8, 0.95, 15.51), (16, 0.99, 32.0)])
def test_quantile(freedom, share, value):
    assert A.chi_square_quantile(share, freedom) == pytest.approx(value, rel=0.01)


@pytest.mark.parametrize("shard", [100, 4096])
def test_table_recall(spark, monkeypatch, shard):
    monkeypatch.setattr(A, "SHARD_ROWS", shard)
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    got = lists(A.nearest(table))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.9
    for q, found in got.items():
        scores = dict(want[q])
        assert all(scores[i] == s for i, s in found if i in scores)


def test_unequal_lengths_and_early_stop():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24)) * 3
    vectors = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 24)) * 0.1
    vectors *= rng.uniform(0.8, 1.2, size=(4000, 1))
    tree = A.ProjectedTree(vectors)
    rows, visited = tree.search(vectors[:100], 20)
    hits = [len(set(r) & set(np.argsort(-(vectors @ q))[:20])) for r, q in zip(rows, vectors[:100])]
    assert np.mean(hits) / 20 >= 0.9
    assert visited.mean() < 0.7 * len(tree.leaves)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "SHARD_ROWS", 30)
    monkeypatch.setattr(A, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(60)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.5]) for i in range(60, 160)]
    bad = [(300, None), (320, [0.0] * 6), (340, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (360, [math.nan] * 6),
           (380, [math.inf] + [1.0] * 5), (None, [1.0] * 6), (400, []), (501, [1.0, 2.0])]
    table = spark.createDataFrame(
        [(i, v, "x", 7) for i, v in rows + bad + rows[:5]], "vec_id long, embedding array<double>, shard string, score int")
    want = brute(rows)
    got = lists(A.nearest(table))
    assert got == want
    few = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])]
    assert lists(A.nearest(spark.createDataFrame(few, "vec_id long, embedding array<float>"))) == {0: [(1, 0.5), (2, 0.5)]}
    assert A.nearest(table.limit(0)).count() == 0
