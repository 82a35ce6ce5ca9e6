import random
import re

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from semblance.llm import token_counts as T

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ROWS = [
    (1, "Hello  world", "a"), (2, "Hello world", "a"), (2, "Hello world", "b"), (3, None, None), (4, "", "x"),
    (None, "no id\tat all", "x"), (None, "another without", "x"), (5, "a <|endoftext|> b <| ENDOFTEXT|>", "x"),
    (6, "word " * 40000, "y"), (7, " x\n\n y\r\n", "z"), (8, "é ﬁ　\x85日本", "z"), (2, "other text", "c"),
]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, digest string")


def library(path):
    if path.endswith(".json"):
        model = Tokenizer.from_file(path)
        return lambda t: len(model.encode(t, add_special_tokens=False).ids)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda t: len(model.encode(t))


@pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
def test_counts_like_library(docs, tmp_path, path):
    count = library(path)
    got = T.token_counts(docs, path, f"file://{tmp_path}/cache").collect()
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 2048) for i, t, _ in ROWS]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_only_misses_are_encoded(spark, docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    T.token_counts(docs.filter("doc_id = 1"), WORDS, cache).collect()
    stored = spark.read.parquet(cache)
    assert stored.count() == 1
    # A stored count is believed, so a hit is not encoded again.
    marked = f"file://{tmp_path}/marked"
    stored.selectExpr("digest", "n_tokens + 1000 AS n_tokens", "version").write.parquet(marked)
    got = {r.doc_id: r.n_tokens for r in T.token_counts(docs.filter("text LIKE 'Hello%'"), WORDS, marked).collect()}
    assert got == {1: 1002, 2: 1002}
    assert spark.read.parquet(marked).count() == 1
    T.token_counts(docs, WORDS, marked).collect()
    assert spark.read.parquet(marked).count() == len({" ".join((t or "").split(" ")) for _, t, _ in ROWS}) - 1
    # Another tokenizer version has counts of its own.
    T.token_counts(docs.filter("doc_id = 1"), BYTES, marked).collect()
    assert spark.read.parquet(marked).select("version").distinct().count() == 2


def test_words_of_a_text_add_up():
    assert T.words_apart(WORDS) and not T.words_apart(BYTES) and not T.words_apart(PIECES)
    count, whole = T.counter(WORDS), library(WORDS)
    rng = random.Random(5)
    signs = ["a", "B", "é", "e\u0301", "\u0301", "1", "'s", "!", " ", " ", "\u3000", "\x85", "\x1c", "<|endoftext|>", "<|", "ß", "İ", "日本", "\x00"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(2000)] + ["x" * 10_000, "", " "]
    texts = [re.sub(r"[ \t\n\r]+", " ", t) for t in texts]
    assert count(texts) == [whole(t) for t in texts] == count(texts)


def test_empty_table(docs, tmp_path):
    assert T.token_counts(docs.limit(0), WORDS, f"file://{tmp_path}/cache").count() == 0
