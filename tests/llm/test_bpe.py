import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from semblance.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.codec(PATH)


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = CODEC.encode(text)
    assert got.tolist() == want, repr(text)
    assert CODEC.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


def plain_merge(word):
    """Ids of a word by merging the first pair of the lowest rank again and again."""
    merges = CODEC.merges
    parts = [i for i in word[:-1]] + [256 + word[-1]]
    while True:
        ranked = [(merges.joined[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in merges.joined]
        if not ranked:
            return [merges.ids[p] for p in parts]
        rank, i = min(ranked)
        parts[i:i + 2] = [rank]


@pytest.mark.parametrize("text", [
    "", " ", "Hello  world's", "x<|endoftext|>y <|startoftext|><|ENDOFTEXT|>", "ΟΔΟΣ ΣΑΣ", "é ﬁ İi",
    "a\x00b\x1cc\x85d e f　g", "don't I'LL we're", "12345 x1y2", "$$$ %%% &&& ... !?", "日本語 한국어 🙂🙂",
    "a" * 5000, "ab" * 3000, "!" * 3001,
])
def test_like_library(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same(text)


def test_every_character_between_letters():
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(chars), 500):
        same("".join(f"a{c}b " for c in chars[at:at + 500]))


def test_words_by_plain_merging():
    rng = random.Random(3)
    for _ in range(400):
        word = bytes(rng.choices(b"aehinorst\xc3\xa9", k=rng.randint(1, 25)))
        assert CODEC.merges.encode(word) == plain_merge(word)


def test_documents(spark):
    rows = [(1, "Hello <|endoftext|> you", 7), (1, "Hello <|endoftext|> you", 8), (None, None, 9), (3, "", 10),
            (4, "long " * 30000, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.encode_documents(docs, PATH)
    assert got.columns == ["doc_id", "text", "n_tokens", "token_ids", "decoded"]
    for r in bpe.digests(got).collect():
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        ids = LIBRARY.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(
            LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_frequent_words_survive_a_full_memory(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 4)
    coder, asked = bpe.Codec(PATH), []
    plain = coder.merges.encode
    monkeypatch.setattr(coder.merges, "encode", lambda word: asked.append(word) or plain(word))
    texts = [f"often {a} often {b} often" for a, b in zip("abcdefgh", "ijklmnop")]
    assert [coder.encode(t).tolist() for t in texts] == [CODEC.encode(t).tolist() for t in texts]
    assert asked.count(b"often") == 1 and len(asked) == 17
    assert max(len(coder.words), len(coder.older)) <= 4
