import hashlib
import itertools

import public_tokenizers
import pytest
from test_decontaminate import plain as plain_hits
from test_substrings import plain as plain_repeats
from tokenizers import Tokenizer

import corpus_pipeline as C
from semblance.llm import toxicity
from semblance.llm.simhash import fingerprint
from semblance.llm.storage import held_out

SMALL = "/root/testdata/sf0.001"


def plain_groups(rows):
    """``{doc_id}`` of the smallest id of each group of fingerprints linked at two bits."""
    fps = {i: fingerprint(t) & (1 << 64) - 1 for i, t in rows}
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            ra, rb = sorted((find(a), find(b)))
            root[rb] = ra
    return {find(i) for i in ids}


def test_stages_like_plain_python(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").selectExpr("doc_id", "toxic AS label")
    model = toxicity.train(table, labels.filter(~held_out("doc_id", 3, 1)))
    rows = [(i, t) for i, t in sorted(texts.items()) if model.scores([t]).round(6)[0] < 0.7]
    stay = plain_groups(rows)
    rows = [(i, t) for i, t in rows if i in stay]
    rows = [(i, t) for i, (t, n) in plain_repeats(rows).items() if not n or t.strip()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    bad = {i for i, _, _ in plain_hits(rows, items)}
    want = {i: t for i, t in rows if i not in bad}
    got = {r.doc_id: r for r in C.run(spark, SMALL).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert len(texts) > len(want) > len(texts) / 2
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, r in got.items():
        ids = library.encode(want[i], add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(40)
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns


@pytest.mark.parametrize("stage", [s for _, s in C.STAGES])
def test_odd_rows(spark, stage):
    text = "One two three four five. Six seven eight nine ten, eleven twelve thirteen. Fourteen fifteen sixteen."
    rows = [(1, text, "en", "score", 4), (1, text, "en", "score", 4), (None, None, None, None, None), (None, "a b", None, None, 1),
            (2, "", "en", None, 0), (3, "word " * 30_000, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, predicted string, n_removed long")
    got = stage(spark, docs, SMALL).collect()
    assert any(r.doc_id == 3 for r in got)
    if stage is not C.encode:
        assert {r.predicted for r in got} <= {"score", None}
    assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d"), (4, "A  b c d"), (4, "A  b c d"), (None, "a b c d"), (None, "q r s"), (None, "Q r s"), (7, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = C.drop_near_duplicates(spark, docs, SMALL).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 4, 7]


def test_clashing_names_pass_through(spark):
    """A column called like a helper column is neither lost nor in the way."""
    from semblance.llm import simhash, substrings

    shared = "one two three four five. six seven eight nine ten. eleven twelve thirteen fourteen fifteen. " * 2
    docs = spark.createDataFrame(
        [(1, shared, "a", "m", 5, "x"), (2, shared, "b", "n", 6, "y"), (3, "alone", "c", "o", 7, "z")],
        "doc_id long, text string, __key string, __marks string, __first int, __id string",
    )
    kept = {r["doc_id"]: r for r in simhash.one_of_each(docs).collect()}
    assert set(kept) == {1, 3} and kept[1]["__key"] == "a" and kept[1]["__id"] == "x"
    cut = {r["doc_id"]: r for r in substrings.remove_repeats(docs, ("n", "f")).collect()}
    assert [cut[k]["__key"] for k in (1, 2, 3)] == ["a", "b", "c"] and cut[2]["__first"] == 6 and cut[2]["n"] > 0


def test_labels_of_repeated_ids_teach_once(spark):
    from semblance.llm import quality

    rows = [(i % 40, ("good words here " if i % 2 else "!!! 1 2 3 ||| ") * 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    a = quality.train(docs, labels, 30)
    b = quality.train(docs.distinct(), labels, 30)
    assert all((x == y).all() for x, y in zip(a.tables, b.tables))
