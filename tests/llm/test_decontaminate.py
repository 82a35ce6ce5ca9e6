import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from semblance.llm import decontaminate as D


def plain(docs, items, threshold=D.CONTAINMENT):
    out = []
    for doc_id, text in docs:
        words = D.words_of(text)
        for item_id, item in items:
            want = D.words_of(item)
            k = min(5, len(want))
            if not k:
                continue
            grams = {tuple(want[i:i + k]) for i in range(len(want) - k + 1)}
            have = {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}
            share = len(grams & have) / len(grams)
            if share >= threshold:
                out.append((doc_id, item_id, share))
    return sorted(out, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=50))
def test_words(text):
    assert len(D.document_hashes(text)) == len(D.words_of(text))


def test_word_hashes_are_equal_only_for_equal_words():
    words = [f"{a}{b}" for a in "abcé7" for b in range(300)]
    hashes = D.word_hashes(" ".join(words).upper() + "," + "_".join(words))
    assert (hashes[: len(words)] == hashes[len(words):]).all()
    assert len(np.unique(hashes)) == len(set(words))


def test_window_minima():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 1000, (D.HASHES, 23)).astype(np.uint32)
    for width in (1, 2, 3, 5, 8, 23, 40):
        w = min(width, 23)
        want = np.stack([blocks[:, i:i + w].min(axis=1) for i in range(23 - w + 1)], axis=1)
        assert (D.window_minima(blocks, width) == want).all()


def test_long_text_in_slices(monkeypatch):
    text = "alpha beta-gamma " * 400
    whole = D.document_hashes(text)
    monkeypatch.setattr(D, "SLICE", 100)
    assert (D.document_hashes(text) == whole).all()


def make(rng):
    names = [f"w{i}" for i in range(800)]
    items = [(i, " ".join(rng.choices(names, k=k))) for i, k in enumerate([1, 2, 4, 5, 6, 9, 12, 13, 20, 33, 40, 64, 70, 130, 300] * 3)]
    docs = []
    for d in range(150):
        words = rng.choices(names, k=rng.randint(0, 1500))
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 2) if len(item) > 40 else 0):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = item
        docs.append((d, " ".join(w.upper() if rng.random() < 0.1 else w + rng.choice(["", ",", "."]) for w in words)))
    return docs, items


def test_like_brute_force(spark, monkeypatch):
    docs, items = make(random.Random(6))
    docs += [(900, None), (901, ""), (902, "..."), (None, "x " + items[9][1]), (5, docs[5][1])]
    items += [(800, None), (801, " - "), (802, items[9][1]), (None, items[10][1])]
    made = (spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string"),
            spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, doc_id int"))
    want = plain(docs, items)
    assert sum(len(i[1].split()) > 30 for i in items if i[1] for w in want if w[1] == i[0]) > 20
    got = sorted((tuple(r) for r in D.contaminations(*made).collect()), key=repr)
    assert got == want
    monkeypatch.setattr(D, "ITEMS_PER_SCAN", 20)
    assert sorted((tuple(r) for r in D.contaminations(*made).collect()), key=repr) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contaminations(docs, items).count() == 1
    assert D.contaminations(docs.limit(0), items).count() == 0
    assert D.contaminations(docs, items.limit(0)).count() == 0
