import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from semblance.functions import scores as S
from semblance.functions import kernels as K
from semblance.functions.kernels import indel_ratio, lcs_length, text_ratio


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_lcs_against_plain_table():
    rng = random.Random(1)
    for _ in range(400):
        a = "".join(rng.choice("abcé😀") for _ in range(rng.randint(0, 30)))
        b = "".join(rng.choice("abcé😀") for _ in range(rng.randint(0, 30)))
        assert lcs_length(a, b) == plain_lcs(a, b) == lcs_length(b, a)


def test_ratio_edge_cases():
    assert indel_ratio("", "") == 1.0
    assert indel_ratio("a", "") == 0.0
    assert indel_ratio("abc", "abc") == 1.0
    assert indel_ratio("kitten", "sitting") == pytest.approx(2 * 4 / 13)


def test_ratio_in_spark(spark):
    rng = random.Random(2)
    rows = [(i, *("".join(rng.choice("abcd") for _ in range(rng.randint(0, 300))) for _ in "ab")) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    for r in df.select("i", text_ratio("a", "b").alias("t")).collect():
        assert r.t == pytest.approx(indel_ratio(*rows[r.i][1:]))


def test_null_pairs_have_null_scores(spark):
    df = spark.createDataFrame([(None, "x")], "a string, b string")
    assert df.select(text_ratio("a", "b")).first()[0] is None


def test_overall_match_is_the_largest_of_the_most_frequent(spark):
    rng = random.Random(9)
    lists = [[], [0.0], [1.0, 1.0]] + [[rng.randint(0, 4) / 4 for _ in range(rng.randint(1, 8))] for _ in range(200)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<double>")
    for r in df.select("i", S.overall_match(F.col("v")).alias("o")).collect():
        counts = Counter(lists[r.i])
        assert r.o == max((v for v, n in counts.items() if n == max(counts.values())), default=0.0)


def test_bands(spark):
    df = spark.createDataFrame([(0.71,), (0.7,), (0.4,)], "s double")
    assert [r[0] for r in df.select(S.overall_band(F.col("s"))).collect()] == ["red", "orange", "green"]
    df = spark.createDataFrame([(0.81,), (0.8,), (0.6,)], "s double")
    assert [r[0] for r in df.select(S.block_band(F.col("s"))).collect()] == ["red", "orange", "green"]


def test_many_texts_beside_one_target():
    rng = random.Random(4)
    texts = ["", "\0", "😀a", "ba\0b 😀"] + ["".join(rng.choice("ab \0😀é") for _ in range(rng.randint(0, 70))) for _ in range(60)]
    for a in texts[:20]:
        assert K.lcs_lengths(a, texts) == [plain_lcs(a, t) for t in texts]
    pairs = [(a, t) for a in texts[:6] for t in [*texts, None]] + [(None, "a")]
    for (a, b), got in zip(pairs, K.indel_ratios(*map(list, zip(*pairs)))):
        assert got == (None if a is None or b is None else indel_ratio(a, b))


def test_shape_gram_counts_are_those_of_the_grams(spark):
    from semblance.functions.arrays import counted
    from semblance.operators.features import shape_gram_counts, shape_grams

    texts = [
        "def f(a, b):\n    return g(a, 1.5) # note\n", "class A:\n  def m(self): pass", "x", "a b", "", None, "\n\n", '"', "''",
        "élan(été) ٣ x٣ 中文(1) 😀(2) \U0001d400(3) \u00b2 € ·", "f\n(x) def g (y) 'a b' + \"c\" True(0)", "a(b)\nc(d)\n" * 50,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw_text string").repartition(2)
    for preserve in (False, True):
        for k in (1, 2, 3):
            new, old = shape_gram_counts(k=k, preserve_names=preserve), counted(shape_grams(k=k, preserve_names=preserve))
            for r in df.select("i", new.alias("new"), old.alias("old")).collect():
                assert (r.new and sorted(map(tuple, r.new))) == (r.old and sorted(map(tuple, r.old))), (texts[r.i], k, preserve)


def test_shape_grams_are_counted_without_lambdas_per_token(spark):
    from semblance.operators.features import shape_gram_counts

    df = spark.createDataFrame([("a(b)",)], "raw_text string").select(shape_gram_counts())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
