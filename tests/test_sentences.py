"""Sentence chunks against a plain walk through the sentences."""

import random
import re

from semblance.operators import sentences as SE

WORD = re.compile(r"\w+|[^\w\s]")


def plain(text, size, overlap):
    units = []
    for sentence in re.findall(r"[^.!?\n]+[.!?]*|[.!?]+", text):
        words = WORD.findall(sentence)
        units += [words[k : k + size] for k in range(0, len(words), size)]
    out, at = [], 0
    while at < len(units):
        end = at
        while end < len(units) and sum(map(len, units[at : end + 1])) <= size:
            end += 1
        out.append(" ".join(w for u in units[at:end] for w in u))
        if end == len(units):
            break
        back = end
        while back - 1 > at and sum(map(len, units[back - 1 : end])) <= overlap and sum(map(len, units[back - 1 : end + 1])) <= size:
            back -= 1
        at = back
    return out


def texts():
    rng = random.Random(5)
    for i in range(25):
        yield f"t{i}", "".join(
            " ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 30]))) + rng.choice([". ", "! ", "?\n", "\n", "... "])
            for _ in range(rng.randint(0, 40))
        )


def test_chunks_are_those_of_a_plain_walk(spark, corpus):
    made = dict(texts()) | {"empty": "", "marks": "...", "one": "a b c", "blank": " \n ", "none": None}
    subs = corpus({"c": made, "d": {"t0": "other text. of one name"}})
    for size, overlap in ((10, 3), (12, 11), (7, 0), (1000, 50)):
        got = {}
        for r in SE.sentence_chunks(subs, size, overlap).collect():
            got.setdefault((r["namespace"], r["name"]), {})[r["chunk_no"]] = r["text"]
        for name, text in made.items():
            mine = got.get(("c", name), {})
            assert [mine[k] for k in sorted(mine)] == plain(text or "", size, overlap), (name, size, overlap)
            assert sorted(mine) == list(range(len(mine)))
        assert got[("d", "t0")][0].startswith("other")
    assert all(len(t.split()) <= 7 for t in got[("c", "one")].values())


def test_no_rows(spark, corpus):
    assert SE.sentence_chunks(corpus({"c": {"t": "a"}}).limit(0)).count() == 0


def test_chunks_are_made_inside_the_row(spark, corpus):
    """Nothing is moved or stored, and the chunks are those found by doubling."""
    made = dict(texts())
    subs = corpus({"c": made})
    chunks = SE.sentence_chunks(subs, 12, 5)
    assert "Exchange" not in chunks._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(chunks) == rows(SE._chunks_by_units(SE._units(subs, 12), 12, 5))
    # Texts of one name have their units brought together, so each chunk comes with both.
    twice = SE.sentence_chunks(subs.unionByName(subs.filter("name = 't3'")), 12, 5)
    assert rows(twice.filter("name <> 't3'")) == rows(chunks.filter("name <> 't3'"))
    assert twice.columns == chunks.columns and twice.filter("name = 't3'").count() >= 2
