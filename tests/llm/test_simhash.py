import itertools
import random

import pytest
import xxhash

from semblance.llm import simhash


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace(
        "\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    """``{fp: smallest index reachable}`` over all pairs."""
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(values)), 2):
        if (values[a] ^ values[b]).bit_count() <= 2:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return [root(i) for i in range(len(values))]


def test_fingerprint_matches_plain():
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "One", "one TWO", "a b c", "É a\x0bB\x0cc", "x y z w"]
    texts += [" ".join(rng.choices(["ab", "cd", "Ef", "gh", "ü"], k=rng.randint(1, 60))) for _ in range(60)]
    for text in texts:
        assert simhash.fingerprint(text) & (1 << 64) - 1 == plain_fingerprint(text)


def test_very_long_text(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 64)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_near_lanes_matches_all_pairs(radius):
    rng = random.Random(radius)
    centre = rng.getrandbits(64)
    values = list({centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1
                   for _ in range(90)})
    got = set(simhash.near_lanes(values, 0, radius))
    want = {(a, b) for a, b in itertools.combinations(range(len(values)), 2)
            if (values[a] ^ values[b]).bit_count() <= radius}
    assert got == want


@pytest.mark.parametrize("bucket", [16, 128])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(7)
    values = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(values)[:5]:
        value = centre
        for _ in range(20):
            value ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(value)
        values |= {centre ^ (1 << i) for i in range(0, 64, 3)}
    values = sorted(values)
    signed = [simhash._signed(v) for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = simhash.links(fps)
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    want = plain_components(values)
    groups = {}
    for v, c in zip(signed, want):
        groups.setdefault(c, []).append(v)
    for members in groups.values():
        assert {got.get(v, v) for v in members} == {min(members)}


def test_documents(spark):
    rows = [
        (5, "Alpha beta gamma delta", "en"), (3, "alpha  BETA gamma delta", "en"), (9, None, None),
        (8, "", None), (1, "nothing like the others at all", "x"), (1, "nothing like the others at all", "x"),
        (None, "alpha beta gamma delta", None), (None, "a lone text without an id", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = sorted(tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "component_id").fillna(-1).collect())
    assert got == [(-1, -1), (-1, 3), (1, 1), (1, 1), (3, 3), (5, 3), (8, 8), (9, 8)]
    found = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    assert found[9] == "0" * 16 and found[3] == f"{plain_fingerprint('alpha beta gamma delta'):016x}"


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
