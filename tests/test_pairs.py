import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from semblance.functions import text as X
from semblance.functions.joins import narrow_join, salted_join, split_join
from semblance.functions.kernels import indel_ratio
from semblance.operators import features as A
from semblance.operators import pairs as P
from semblance.operators import tfidf as TF
from semblance.plans import analysis as AN
from semblance.plans.preprocess import preprocess_all, preprocess_with_cache
from semblance.settings import TextOptions



def steps(seed, names):
    """A random straight program over the given names."""
    rng = random.Random(seed)
    forms = ["{0} = {1} * {2} - {3}", "while {0} < {3}:\n    {1} += {2}", "{0}, {1} = {1}, {0}", "send({0}, to={2})", "del {1}"]
    return "\n".join(rng.choice(forms).format(*rng.sample(names, 3), rng.randint(0, 99)) for _ in range(12))


METALS, TREES = ["iron", "zinc", "tin", "lead"], ["oak", "ash", "elm", "fir"]
CORPORA = {
    "north": {
        "origin": steps(1, METALS), "renamed": steps(1, TREES), "unlike": steps(2, TREES),
        "letter": "Dear reader, there is no program in here; only words.",
    },
    "south": {"origin": steps(5, TREES), "same": steps(5, TREES), "blank": ""},
}


def scored(df, metric):
    return {(r.corpus_id, r.other): r[metric] for r in df.collect()}


def test_every_target_meets_the_rest(corpus):
    subs = corpus(CORPORA)
    targets = P.default_targets(subs)
    assert {tuple(r) for r in targets.collect()} == {("north", "origin"), ("south", "origin")}
    rows = {(r.corpus_id, r.other): r for r in AN.analyze_fast(subs, targets).collect()}
    assert set(rows) == {(c, f) for c, files in CORPORA.items() for f in files if f != "origin"}
    for (c, f), r in rows.items():
        assert all(0 <= r[m] <= 1 for m in ("raw", "processed", "ast", "token", "cover")) and r.error is None
        assert r.raw == pytest.approx(indel_ratio(CORPORA[c]["origin"], CORPORA[c][f]))
    # Renaming changes the words, not the shape.
    assert rows["north", "renamed"].ast == 1.0 > rows["north", "renamed"].token
    assert rows["north", "letter"].ast < rows["north", "unlike"].ast < 1.0
    same, blank = rows["south", "same"], rows["south", "blank"]
    assert [same[m] for m in ("raw", "processed", "ast", "token", "cover")] == [1.0] * 5
    assert [blank[m] for m in ("raw", "ast", "token", "cover")] == [0.0] * 4


def test_names_count_when_preserved(corpus):
    subs = corpus({"c": {"origin": steps(1, METALS), "renamed": steps(1, TREES)}})
    options = TextOptions(preserve_variable_names=True)
    targets = P.default_targets(subs)
    assert AN.analyze_fast(subs, targets, options).first().ast < AN.analyze_fast(subs, targets).first().ast == 1.0


def test_cached_features_score_like_fresh_ones(corpus):
    subs = corpus(CORPORA)
    targets = P.default_targets(subs)
    cached, _ = preprocess_with_cache(subs, preprocess_all(subs.limit(0)))
    fresh, again = (
        sorted(tuple(r) for r in AN.analyze_sparse(subs, targets, features=f).fillna("").collect()) for f in (None, cached)
    )
    assert fresh == again and len(fresh) == 5


def test_bounds_and_symmetry(corpus):
    rng = random.Random(5)
    files = {f"f{i}": "".join(rng.choice("ab cd\né") for _ in range(rng.randint(0, 60))) for i in range(25)}
    subs = corpus({"c": files})
    targets = P.default_targets(subs)
    def counts(rows):
        return P.item_counts(rows, X.characters(F.col("raw_text")))

    bound = scored(P.bag_scores(subs, counts, targets, "b", 1.0), "b")
    exact = scored(P.text_scores(subs, targets, {"raw_text": "raw"}), "raw")
    assert len(bound) == len(exact) == 24
    for key, value in exact.items():
        a, b = files["f0"], files[key[1]]
        assert bound[key] >= value - 1e-12
        want = 2 * sum((Counter(a) & Counter(b)).values()) / (len(a) + len(b)) if a + b else 1.0
        assert bound[key] == pytest.approx(want)
    other_way = targets.withColumn("target", F.lit("f3"))
    back = scored(P.bag_scores(subs, counts, other_way, "b", 1.0), "b")
    assert back[("c", "f0")] == pytest.approx(bound[("c", "f3")])


def test_cosine_against_plain_python(corpus):
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta", "été", "x"]
    corpora = {
        c: {f"f{i}": " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for i in range(9)}
        for c in ("a", "b")
    }
    subs = corpus(corpora)
    got = scored(TF.tfidf_cosine(subs, P.default_targets(subs)), "cosine")
    for c, files in corpora.items():
        bags = {n: Counter(re.findall(r"\b\w\w+\b", t.lower())) for n, t in files.items()}
        df = Counter(t for b in bags.values() for t in b)
        idf = {t: math.log((1 + len(files)) / (1 + k)) + 1 for t, k in df.items()}
        weights = {n: {t: k * idf[t] for t, k in b.items()} for n, b in bags.items()}
        length = {n: math.sqrt(sum(v * v for v in w.values())) for n, w in weights.items()}
        for n in files:
            if n == "f0":
                continue
            dot = sum(v * weights[n].get(t, 0) for t, v in weights["f0"].items())
            norms = length["f0"] * length[n]
            assert got[(c, n)] == pytest.approx(dot / norms if norms else 0.0)


def test_missing_targets(spark, corpus):
    subs = corpus(CORPORA)
    asked = spark.createDataFrame(
        [("south", "origin"), ("south", "lost"), ("west", "origin")], "corpus_id string, target string"
    )
    reasons = {("south", "lost", "Target 'lost' not found"), ("west", "origin", "No submissions provided")}
    assert {tuple(r) for r in P.missing_targets(asked, subs).collect()} == reasons
    rows = AN.analyze_fast(subs, asked).collect()
    assert {(r.corpus_id, r.target, r.error) for r in rows if r.other is None} == reasons
    assert {r.other for r in rows if r.error is None} == {"same", "blank"}


def test_oversized_submission_has_null_scores_only_with_a_limit(corpus):
    subs = corpus({"c": {"a": "x = 1", "b": "y = 2", "big": "z = 3 " * 100}})
    targets = P.default_targets(subs)
    rows = {r.other: r for r in AN.analyze_fast(subs, targets, limit=50).collect()}
    assert rows["b"].raw is not None
    assert [rows["big"][m] for m in ("raw", "processed", "ast", "token")] == [None] * 4
    assert all(r.raw is not None for r in AN.analyze_fast(subs, targets).collect())


def test_ranked_report(spark):
    scores = spark.createDataFrame(
        [("c", "t", "a", 0.5, 0.5, 0.9), ("c", "t", "b", 0.2, 0.3, 0.8), ("c", "t", "n", None, None, None)],
        "corpus_id string, target string, other string, raw double, token double, cosine double",
    )
    rows = AN.ranked_report(scores).collect()
    assert [(r.rank, r.other, r.overall, r.band) for r in rows] == [
        (1, "b", 0.8, "red"), (2, "a", 0.5, "orange"), (3, "n", 0.0, "green"),
    ]


def test_hot_key_join_keeps_all_rows(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id)) AS k", "id")
    side = rows.select("k").distinct().withColumn("v", F.length("k"))
    plain = {tuple(r) for r in rows.join(side, "k").collect()}
    assert {tuple(r) for r in salted_join(rows, side, ["k"], ["id"], salts=7).collect()} == plain
    assert {tuple(r) for r in split_join(rows, side, ["k"], ["id"], rows_per_part=100).collect()} == plain
    assert {tuple(r) for r in split_join(rows, side, ["k"], ["id"]).collect()} == plain
    assert {tuple(r) for r in narrow_join(rows, side, ["k"], ["id"]).collect()} == plain


def test_structure_profile(corpus):
    code = "import os\nfor i in range(3):\n    if i > 1:\n        print(i + 1)\n"
    subs = corpus({"c": {"f": code}})
    got = {(r.family, r["item"]): r.n for r in A.structure_profile(subs).collect()}
    assert got[("function_calls", "FUNC_CALL")] == 2
    assert got[("control_flow", "For")] == got[("control_flow", "If")] == 1
    assert got[("operators", ">")] == got[("operators", "+")] == 1
    named = {r["item"] for r in A.structure_profile(subs, preserve_names=True).filter("family = 'function_calls'").collect()}
    assert named == {"range", "print"}


def test_pairs_of_a_hot_corpus(corpus, monkeypatch):
    """A corpus with most of the rows is split and still meets its target completely."""
    from semblance.functions import joins

    monkeypatch.setattr(joins, "ROWS_PER_PART", 7)
    subs = corpus({"hot": {f"f{i}": f"word{i % 5} common" for i in range(90)}, "cold": {"a": "x y", "b": "x"}})
    targets = P.default_targets(subs)
    assert P.target_pairs(subs, targets).count() == 90
    scores = scored(P.text_scores(subs, targets, {"raw_text": "raw"}), "raw")
    assert len(scores) == 90 and scores[("hot", "f5")] == 1.0
    cosine = scored(TF.tfidf_cosine(subs, targets), "cosine")
    assert len(cosine) == 90 and cosine[("hot", "f5")] == pytest.approx(1.0)


def test_counted_in_the_row(spark):
    rng = random.Random(3)
    lists = [[], [None], ["a"], ["a", None, "a"]] + [[rng.choice("abcdé") for _ in range(rng.randint(0, 40))] for _ in range(30)]
    df = spark.createDataFrame([("c", str(i), v) for i, v in enumerate(lists)], "corpus_id string, name string, x array<string>")
    got = P.item_counts(df, F.col("x"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in got.collect():
        found.setdefault(int(r.name), {})[r["item"]] = r.n
    assert found == {i: dict(c) for i, v in enumerate(lists) if (c := Counter(x for x in v if x is not None))}


def test_join_is_split_by_bytes(spark, monkeypatch):
    from semblance.functions import joins

    monkeypatch.setattr(joins, "BYTES_PER_PART", 1000)
    rows = spark.range(200).selectExpr("'one' AS k", "id", "repeat('x', 100) AS text")
    side = spark.createDataFrame([("one", 7)], "k string, v int")
    joined = split_join(rows, side, ["k"], ["id"], weight=F.octet_length("text"))
    assert joined.count() == 200 and joined.filter("v = 7").count() == 200
    salted = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in salted and "_salt" not in split_join(rows, side, ["k"], ["id"])._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", ["all", "frequent", "none"])
def test_tfidf_weights_move_no_frequent_term(spark, corpus, monkeypatch, few):
    texts = {f"n{i}": " ".join(["the", "and"] * (i % 3 + 1) + [f"w{i}", f"v{i // 4}"]) for i in range(40)}
    texts["blank"] = "."
    subs = corpus({"a": texts, "b": {"x": "the end"}})
    subs = subs.unionByName(subs.filter("name = 'n1'"))
    if few == "frequent":
        monkeypatch.setattr(TF, "is_small", lambda df: df.count() <= 4)
        monkeypatch.setattr(TF, "BROADCAST_TERMS", 4)
    elif few == "none":
        monkeypatch.setattr(TF, "is_small", lambda df: False)
    weights = TF.tfidf_weights(subs)
    bags = {"a": [(n, Counter(t.split())) for n, t in [*texts.items(), ("n1", texts["n1"])] if n != "blank"]}
    bags["b"] = [("x", Counter(["the", "end"]))]
    n_docs, want = {"a": 42, "b": 1}, []
    for c, rows in bags.items():
        df = Counter(t for _, bag in rows for t in bag)
        w = [(n, t, tf, tf * (math.log((1 + n_docs[c]) / (1 + df[t])) + 1)) for n, bag in rows for t, tf in bag.items()]
        square = Counter()
        for n, _, _, x in w:
            square[n] += x * x
        want += [(c, n, t, tf, round(x / math.sqrt(square[n]), 9)) for n, t, tf, x in w]
    got = [(r.corpus_id, r.name, r.term, r.tf, round(r.weight, 9)) for r in weights.collect()]
    assert sorted(got) == sorted(want)
    if few == "all":
        # The texts move once, by name; their counts do not move at all.
        plan = weights._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
