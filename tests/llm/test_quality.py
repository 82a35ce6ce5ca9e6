import numpy as np

from semblance.llm import quality as Q
from semblance.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def test_features_are_finite():
    for text in (None, "", " ", "\n\n", "word", "a b " * 100_000, "é" * 10, "!!! ???"):
        found = Q.features(text)
        assert len(found) == len(Q.FEATURES) and np.isfinite(found).all()


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(0)
    rows = rng.random((4000, len(Q.FEATURES)))
    labels = ((rows[:, 2] > 0.5) ^ (rows[:, 7] > 0.5)).astype(float)
    model = Q.fit(rows, labels)
    assert any({a, b} == {2, 7} for a, b, _ in model.pairs)
    assert ((model.score(rows) >= 0.5) == labels).mean() > 0.95


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(1)
    rows = rng.random((500, len(Q.FEATURES)))
    model = Q.fit(rows, (rows[:, 0] + 0.2 * rng.random(500) > 0.6).astype(float))
    row = rows[3]
    total = model.base + sum(t[sum(row[k] >= e for e in model.edges[k])] for k, t in enumerate(model.tables))
    total += sum(g[sum(row[a] >= e for e in model.coarse[a]), sum(row[b] >= e for e in model.coarse[b])] for a, b, g in model.pairs)
    assert abs(model.score(rows)[3] - 1 / (1 + np.exp(-total))) < 1e-12


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op2_quality"](spark, SMALL).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [i for i in labels if got[i].held_out]
    assert sum(got[i].predicted == labels[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a fine text", 0), (1, "a fine text", 0), (None, None, 1), (2, "", 1), (3, "long " * 100_000, 1)],
        "doc_id long, text string, label int",
    )
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, label int")
    one = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, label int")
    for labels in (none, one):
        got = Q.score(docs, Q.train(docs, labels)).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert Q.score(docs.limit(0), Q.train(docs.limit(0), one)).count() == 0
