import random

from hypothesis import given, settings
from hypothesis import strategies as st

from semblance.llm import substrings as S


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,\n!İ ", max_size=200))
def test_units_are_the_text(text):
    cut = S.units(text)
    assert "".join(p for p, _ in cut) == (text if text.split() else "")
    assert [w for _, ws in cut for w in ws] == text.lower().split()
    assert all(ws for _, ws in cut)


def plain(rows):
    """Brute force over all spans of all texts."""
    cuts = {i: S.units(t or "") for i, t in rows}
    first = {}
    places = {}
    for i in sorted(cuts):
        n = len(cuts[i])
        for a in range(n):
            b = next((b for b in range(a + S.SPAN_UNITS, n + 1)
                      if sum(len(w) for _, w in cuts[i][a:b]) >= S.SPAN_WORDS), None)
            if b:
                key = tuple(tuple(w) for _, w in cuts[i][a:b])
                first.setdefault(key, (i, a))
                places[i, a] = (key, b)
    out = {}
    for i, t in rows:
        gone = set()
        for (j, a), (key, b) in places.items():
            if i == j and first[key] != (i, a):
                gone |= set(range(a, b))
        out[i] = ("".join(p for k, (p, _) in enumerate(cuts[i]) if k not in gone) if gone else t, len(gone))
    return out


def sentence(rng):
    return " ".join(rng.choices(["an", "Be", "cat", "dew", "elm", "fox", "gnu"], k=rng.randint(1, 25))) + rng.choice(
        [". ", "! ", ", ", ".\n", "\n", " "])


def test_like_brute_force(spark):
    rng = random.Random(4)
    passages = ["".join(sentence(rng) for _ in range(8)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [sentence(rng) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), "word " + rng.choice(passages))
        rows.append((i * 3, "".join(parts)))
    rows += [(500, None), (501, ""), (502, " \n "), (503, "short.")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, marks string")
    got = {r.doc_id: (r.text, r.n_removed) for r in S.remove_repeats(docs).collect()}
    assert got == plain(rows)
    assert sum(n for _, n in got.values()) > 100


def test_passage_inside_other_sentences(spark):
    rng = random.Random(8)
    names = [f"w{i}" for i in range(3000)]
    passage = " ".join(" ".join(rng.choices(names, k=9)) + p for p in (".", ",", "", ".", ",", "."))
    rows = []
    for i in range(300):
        words = rng.choices(names, k=60)
        if i % 3 == 0:
            words.insert(rng.randint(0, 60), passage)
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        if i % 3 or i == 0:
            assert got[i].text == text and got[i].n_removed == 0
        else:
            assert len(got[i].text.split()) < 60 + 25 and 0 in got[i].first_docs


def test_copies_nulls_and_repeated_rows(spark):
    text = "One two three four five. Six seven eight nine ten, eleven twelve thirteen. Fourteen fifteen sixteen."
    other = "A text of its own, under an id that is used twice. It shares nothing, and nothing is cut from it here."
    rows = [(7, text), (7, text), (9, text.upper()), (None, text), (8, text + " " + text), (9, other)]
    got = sorted(((r.doc_id or 0, r.text) for r in S.remove_repeats(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(0, ""), (7, text), (7, text), (8, ""), (9, ""), (9, other)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.remove_repeats(empty).count() == 0


def test_very_long_text():
    text = " ".join(f"w{i}" for i in range(300_000))
    assert S.covered_units(S.units(text), set()).count(True) == 0


def test_fifty_shared_words_hold_a_span():
    """Runs of words without marks, in the middle of other words, with any frequency of words."""
    rng = random.Random(3)
    for size in (20, 200, 5000):
        names = [f"n{i}" for i in range(size)]
        for _ in range(400):
            passage = rng.choices(names, k=50)
            found = []
            for _ in range(2):
                words = [*rng.choices(names, k=rng.randint(0, 40)), *passage, *rng.choices(names, k=rng.randint(0, 40))]
                found.append({mark for mark, _, _ in S.spans(S.units(" ".join(words)))})
            assert found[0] & found[1]


def test_passages_without_spaces():
    """Shared passages of scripts without spaces hold a span, with and without wide marks."""
    rng = random.Random(6)
    for low, high in ((0x4E00, 0x5600), (0x3041, 0x3097), (0xE01, 0xE31)):
        letters = [chr(c) for c in range(low, high)]
        for marks in (0, 1):
            passage = "".join(c + ("，" if marks and k % 9 == 8 else "") for k, c in enumerate(rng.choices(letters, k=50)))
            found = []
            for _ in range(2):
                text = "".join([*rng.choices(letters, k=30), passage, *rng.choices(letters, k=30)])
                cut = S.units(text)
                assert "".join(p for p, _ in cut) == text and max(len(w) for _, w in cut) <= S.PIECE_WORDS
                found.append({mark for mark, _, _ in S.spans(cut)})
            assert found[0] & found[1]
    cut = S.units("你好。」世界，Python3。Java is here. กา")
    assert [p for p, _ in cut] == ["你好。」", "世界，", "Python3。", "Java is here. ", "กา"]
    assert cut[0][1] == ["你", "好。」"]
