import numpy as np
import pytest

from semblance.llm import toxicity as X
from semblance.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
CLEAN = "the cat sat on a mat and looked out of the window for a bird that never came back".split()


def texts(n, seed):
    rng = np.random.default_rng(seed)
    made, labels = [], []
    for i in range(n):
        words = list(rng.choice(CLEAN, size=int(rng.integers(5, 120))))
        if i % 4 == 0:
            words.insert(int(rng.integers(0, len(words))), f"vile{'abcdefgh'[i // 4 % 8]}")
        made.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return made, np.array(labels)


def windows(text):
    words = X.words_of(text)
    return [words[s:s + X.WINDOW] for s in X.window_starts(len(words))]


@pytest.fixture(scope="module")
def net():
    made, labels = texts(240, 1)
    return X.fit([windows(t) for t in made], labels)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 48, 49, 200])
def test_windows_overlap_and_cover(n):
    starts = X.window_starts(n)
    covered = {p for s in starts for p in range(s, min(s + X.WINDOW, n))}
    assert covered == set(range(n))
    assert all(b - a <= X.STRIDE for a, b in zip(starts, starts[1:]))


def test_gradients_by_differences(net):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 5, X.INPUTS))
    mask = (rng.random((6, 5)) < 0.7).astype(float)
    mask[0] = 1
    labels, weight = rng.integers(0, 2, 5).astype(float), rng.random(5)
    model = X.Network(net.word_odds, net.gram_odds, net.known, {k: v.astype(float) for k, v in net.weights.items()})

    def loss():
        gates = model.gate_inputs(x.reshape(30, X.INPUTS))
        logit = model.logits(np.arange(30).reshape(6, 5), mask, gates)
        return float((weight * (np.logaddexp(0, logit) - labels * logit)).sum())

    slopes = model.slopes(x, mask, labels, weight)
    for name, value in model.weights.items():
        for place in [tuple(rng.integers(0, d) for d in value.shape) for _ in range(4)]:
            old, small = value[place], 1e-2
            value[place] = old + small
            up = loss()
            value[place] = old - small
            down = loss()
            value[place] = old
            assert slopes[name][place] == pytest.approx((up - down) / (2 * small), abs=2e-2, rel=0.05), name


def test_unseen_forms_by_spelling_anywhere_in_a_long_text(net):
    long = " ".join(CLEAN * 200).split()
    assert net.scores([" ".join(long)])[0] < 0.7
    for at in (0, 1700, len(long)):
        assert net.scores([" ".join([*long[:at], "vilez", *long[at:]])])[0] >= 0.7


def test_batches_do_not_matter(net, monkeypatch):
    made, _ = texts(40, 5)
    whole = net.scores(made)
    assert np.allclose(whole, [net.scores([t])[0] for t in made], atol=1e-4)
    monkeypatch.setattr(X, "KEPT_WORDS", 3)
    monkeypatch.setattr(X, "CHUNK_WORDS", 50)
    monkeypatch.setattr(X, "SCORED_WINDOWS", 2)
    assert np.allclose(whole, net.scores(made), atol=1e-4)


def test_worst_window_by_plain_recurrence(net):
    """The logit of one window by a word-at-a-time recurrence."""
    words = [*CLEAN, "vileq", *CLEAN][: X.WINDOW]
    w, n = net.weights, X.STATES
    x = np.concatenate([net.inputs([word]) for word in words])
    rows = []
    for k, order in ((0, range(len(words))), (1, range(len(words) - 1, -1, -1))):
        h, states = np.zeros(n), {}
        for t in order:
            gx, gh = x[t] @ w["wx"][:, k] + w["b"][k], h @ w["wh"][k]
            z, r = 1 / (1 + np.exp(-(gx + gh)[:n])), 1 / (1 + np.exp(-(gx + gh)[n:2 * n]))
            h = z * h + (1 - z) * np.tanh(gx[2 * n:] + r * gh[2 * n:])
            states[t] = h
        rows.append(np.array([states[t] for t in range(len(words))]))
    joint = np.concatenate(rows, axis=1)
    force = np.tanh(joint @ w["wa"]) @ w["va"]
    share = np.exp(force) / np.exp(force).sum()
    assert net.text_logits([words])[0] == pytest.approx(share @ joint @ w["wo"] + w["bo"][0], abs=1e-3)


def test_held_out_on_the_tables(spark):
    got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, SMALL).collect()}
    docs = {r.doc_id for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert set(got) == docs
    held = [i for i in labels if got[i].held_out]
    assert sum(got[i].predicted == labels[i] for i in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_rows(spark):
    made, labels = texts(80, 9)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(made)], "doc_id long, text string, label string")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (3, None)], "doc_id long, label int")
    odd = spark.createDataFrame([(1, None, 0.0), (None, "", 0.0), (2, "12 !", 0.0), (2, "12 !", 0.0)], "doc_id long, text string, score double")
    net = X.train(docs, marks)
    got = X.score(odd, net).collect()
    assert sorted((r.doc_id or 0, r.score, r.predicted) for r in got) == [(0, 0.0, 0), (1, 0.0, 0), (2, 0.0, 0), (2, 0.0, 0)]
    one_kind = X.train(docs, marks.filter("label = 0"))
    assert {r.predicted for r in X.score(docs, one_kind).collect()} == {0}
    assert X.score(odd.limit(0), X.train(docs.limit(0), marks)).count() == 0


def test_all_windows_are_learned_from(spark, monkeypatch):
    """The windows that the fit gets are those of the whole texts, however long they are."""
    made = [" ".join(f"w{'abcdefghij'[k % 10] * (i + 1)}{'xyz'[k % 3]}" for k in range(n)) for i, n in enumerate((5, 900, 4000))]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    marks = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id long, label int")
    taken = []
    monkeypatch.setattr(X, "fit", lambda texts, labels: taken.append((texts, labels)))
    X.train(docs, marks)
    (found, labels), = taken
    assert sorted(labels) == [0, 1, 1]
    assert sorted(found) == sorted(windows(t) for t in made)
