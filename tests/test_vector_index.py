"""An index over vectors finds what a scan of all vectors finds, from fewer rows."""

import numpy as np
import pytest

from semblance.operators import vector_index as VI
from semblance.operators import vectors as VE
from semblance.plans import analysis as AN
from semblance.streaming import streams as SM

CHUNKS = "namespace string, name string, chunk_no int, embedding array<double>"
QUERIES = "namespace string, query string, embedding array<double>"


def _rows(df):
    return sorted((r.namespace, r.query, r["rank"], r.name, r.chunk_no, round(r.score, 9)) for r in df.collect())


def _clustered(n, groups, seed=1, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, width))
    return centres[rng.integers(groups, size=n)] * rng.uniform(0.5, 3, size=(n, 1)) + rng.normal(size=(n, width)) * 0.05


@pytest.mark.parametrize("groups, share", [(40, 0.5), (3000, 1.0)])
def test_index_equals_scan(spark, groups, share):
    vectors = _clustered(3000, groups)
    # One namespace holds two thirds of the rows.
    chunks = spark.createDataFrame(
        [("a" if i % 3 else "b", f"f{i // 4}", i % 4, v.tolist()) for i, v in enumerate(vectors)], CHUNKS)
    queries = spark.createDataFrame(
        [(n, f"q{i % 5}", vectors[i].tolist()) for n in "ab" for i in range(0, 3000, 400)], QUERIES)
    centres = VI.fit_cells(chunks, cells=40, sample=1000)
    index = VI.assign_cells(chunks, centres)
    assert _rows(VI.index_topk(index, queries, centres)) == _rows(VE.vector_topk(chunks, queries))
    read = VI.visited_cells(index, queries, centres).groupBy().sum("n").first()[0]
    assert read <= share * 3000 * 5, read / (3000 * 5)


def test_stored_index_opens_only_its_cells(spark, tmp_path):
    vectors = _clustered(400, 8)
    chunks = spark.createDataFrame([("a", f"f{i}", 0, v.tolist()) for i, v in enumerate(vectors)], CHUNKS)
    centres = VI.fit_cells(chunks, cells=8)
    path = str(tmp_path / "index")
    VI.write_index(chunks.filter("name < 'f2'"), centres, path)
    VI.write_index(chunks.filter("name >= 'f2'"), centres, path)
    queries = spark.createDataFrame([("a", "q", vectors[3].tolist())], QUERIES)
    found = VI.index_topk(spark.read.parquet(path), queries, centres)
    assert _rows(found) == _rows(VE.vector_topk(chunks, queries))
    assert "PartitionFilters: [isnotnull(cell" in found._jdf.queryExecution().toString() or "PartitionFilters: [cell" in (
        found._jdf.queryExecution().toString())


def test_odd_vectors(spark):
    rows = [("a", "zero", 0, [0.0, 0.0]), ("a", "null", 0, None), ("a", "nan", 0, [float("nan"), 1.0]), ("a", "wide", 0, [1.0] * 3),
            ("a", "hole", 0, [1.0, None]), ("a", "same", 0, [1.0, 0.0]), ("a", "same", 1, [2.0, 0.0]), ("a", "back", 0, [-1.0, 0.0]),
            (None, "lost", 0, [1.0, 0.0])]
    chunks = spark.createDataFrame(rows, CHUNKS)
    queries = spark.createDataFrame(
        [("a", "q", [1.0, 0.0]), ("a", "q", None), ("a", "z", [0.0, 0.0]), ("b", "q", [1.0, 0.0])], QUERIES)
    centres = [[1.0, 0.0], [-1.0, 0.0]]
    got = _rows(VI.index_topk(VI.assign_cells(chunks, centres), queries, centres, k=3))
    assert [r[1:] for r in got] == [
        ("q", 1, "same", 0, 1.0), ("q", 2, "same", 1, 1.0), ("q", 3, "zero", 0, 0.0),
        ("z", 1, "back", 0, 0.0), ("z", 2, "same", 0, 0.0), ("z", 3, "same", 1, 0.0),
    ]
    empty = spark.createDataFrame([], CHUNKS)
    none = VI.fit_cells(empty)
    assert VI.index_topk(VI.assign_cells(empty, none), queries, none).collect() == []


def test_index_kept_up_by_a_stream(spark, tmp_path):
    source, store, check = (str(tmp_path / x) for x in ("in", "store", "check"))
    centres = [[1.0, 0.0], [0.0, 1.0]]
    queries = spark.createDataFrame([("a", "q", [1.0, 0.0])], QUERIES)

    def send(rows):
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(source)
        SM.index_stream(spark.readStream.schema(CHUNKS).parquet(source), store, centres, check).awaitTermination()
        hits = VI.index_topk(SM.indexed_chunks(spark, store), queries, centres, 2).collect()
        return sorted((r["rank"], r.name, r.chunk_no) for r in hits)

    assert send([("a", "f", 0, [1.0, 0.0]), ("a", "f", 1, [1.0, 0.1]), ("a", "g", 0, [0.1, 1.0])]) == [(1, "f", 0), (2, "f", 1)]
    # The file's new vectors replace both of the old ones.
    assert send([("a", "f", 0, [0.0, 1.0]), ("a", "h", 0, None)]) == [(1, "g", 0), (2, "f", 0)]
    assert send([("a", "h", 0, [1.0, 0.0])]) == [(1, "h", 0), (2, "g", 0)]


def test_analysis_from_an_index(spark):
    names = [f"f{i}" for i in range(12)]
    subs = spark.createDataFrame([("a", n, f"x = {n}", i) for i, n in enumerate(names)], "corpus_id string, name string, raw_text string, ingest_order long")
    targets = spark.createDataFrame([("a", "f0")], "corpus_id string, target string")
    chunks = spark.createDataFrame([("a", n, 0, v.tolist()) for n, v in zip(names, _clustered(12, 3))], CHUNKS)
    centres = VI.fit_cells(chunks, cells=3)
    plain = AN.analyze_vector(subs, targets, chunks, k=4)
    indexed = AN.analyze_vector(subs, targets, VI.assign_cells(chunks, centres), k=4, centres=centres)
    assert sorted(map(tuple, indexed.collect())) == sorted(map(tuple, plain.collect()))
