import zlib

import numpy as np
import pytest

from semblance.llm import langid as L
from semblance.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 30])
def test_codewords_differ(n):
    codes = L.codewords(n)
    assert codes.shape[0] == n and set(np.unique(codes)) <= {-1.0, 1.0}
    apart = [(codes[a] != codes[b]).sum() for a in range(n) for b in range(a)]
    assert min(apart) >= (1 if n < 4 else 3)


def test_grams_by_plain_count():
    text = "Ab, c-é 1"
    words = " ab c é "
    total = sum(len(words) - k + 1 for k in L.ORDERS)
    assert L.gram_counts(text).sum() == total
    assert L.gram_counts(None) is None and L.gram_counts("12 !\n") is None


def test_long_text_in_slices(monkeypatch):
    text = "one two three " * 500
    whole = L.gram_counts(text)
    monkeypatch.setattr(L, "SLICE", 1000)
    assert abs(L.gram_counts(text).sum() / whole.sum() - 1) < 0.01


def test_single_language_and_none():
    counts = L.gram_counts("hello there")
    assert L.fit({"en": counts}).scores(counts).tolist() == [1.0]
    assert L.fit({}).languages == []


def test_held_out_accuracy(spark):
    got = QUERIES["op1_langid"](spark, SMALL).collect()
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(docs)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.96 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_rows(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    model = L.train(spark.createDataFrame([*train, (99, "x", None), (100, None, "en")], "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    rows = [(1, "the dog", "zz"), (1, "the dog", "zz"), (None, "die katze", None), (2, None, "en"), (3, "", "en"), (4, "12 !", "de"),
            (5, "the and " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted(((r.doc_id, r.lang_pred, r.score > 0) for r in L.predict(docs, model).collect()), key=repr)
    assert got == sorted([(1, "en", True), (1, "en", True), (None, "de", True), (2, "und", False), (3, "und", False),
                          (4, "und", False), (5, "en", True)], key=repr)
    empty = docs.limit(0)
    assert L.predict(empty, model).count() == 0
    none = L.train(empty.selectExpr("doc_id", "text", "text AS lang"))
    assert {r.lang_pred for r in L.predict(docs, none).collect()} == {"und"}
