import hashlib
import random

from pyspark.sql import functions as F

from semblance.functions import text as X
from semblance.operators.features import chunk_texts, guard_size
from semblance.settings import TextOptions


def apply(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def python_ws(text):
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def test_whitespace_agrees_with_python(spark):
    rng = random.Random(3)
    signs = ["a", "é", " ", "\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", " ", "　"]
    texts = ["".join(rng.choice(signs) for _ in range(40)) for _ in range(300)] + ["", " \n ", "\n" * 5000 + "x"]
    assert apply(spark, texts, X.normalize_ws) == [python_ws(t) for t in texts]
    assert apply(spark, texts, X.is_nonblank) == [bool(t.strip()) for t in texts]


def test_comments_and_docstrings(spark):
    code = 'x = 1 # one\n"""doc\nmore"""\ns = "a#b"\ny = 2'
    assert apply(spark, [code], X.strip_comments) == ['x = 1 \n\ns = "a\ny = 2']


def test_literals(spark):
    cases = {
        'a = "x" + \'y\'': "a = 'STR' + 'STR'",
        'b = ""': 'b = ""',
        'c = "say \\"hi\\""': "c = 'STR'",
        "d = 12 + 3.5e3 + 0x1F, 7": "d = 0 + 0 + 0, 0",
        "e = True and not False": "e = 0 and not 0",
        "v2 = x1": "v2 = x1",
        "f = '''a\nb'''": "f = 'STR'",
    }
    assert apply(spark, list(cases), X.anonymize_literals) == list(cases.values())


def test_long_inputs_do_not_exhaust_the_regex_stack(spark):
    long = '"' + "a" * 400_000 + '" ' + "\n \n" * 100_000 + "'" + "b" * 200_000
    out = apply(spark, [long], X.preprocess)[0]
    assert out.startswith("'STR'") and out.endswith("b" * 1000)


def test_options(spark):
    code = "x  = 5 # n"
    keep = TextOptions(remove_comments=False, normalize_whitespace=False, preserve_literals=True)
    assert apply(spark, [code], lambda c: X.preprocess(c, keep)) == [code]
    assert apply(spark, [code], X.preprocess) == ["x = 0"]


def test_tokens_and_hash(spark):
    assert apply(spark, ["def é_1(x):\n return x+1"], X.tokens) == [
        ["def", "é_1", "(", "x", ")", ":", "return", "x", "+", "1"]
    ]
    text = "héllo"
    assert apply(spark, [text], X.content_hash) == [hashlib.md5(text.encode()).hexdigest()[:16]]


def test_chunks(spark, corpus):
    for n, starts in ((1, [0]), (512, [0]), (513, [0, 462]), (974, [0, 462]), (975, [0, 462, 924])):
        subs = corpus({"c": {"f": " ".join(f"w{i}" for i in range(n))}})
        rows = chunk_texts(subs).orderBy("chunk_no").collect()
        assert [r.text.split()[0] for r in rows] == [f"w{s}" for s in starts]
        covered = {w for r in rows for w in r.text.split()}
        assert len(covered) == n


def test_size_guard_counts_bytes(corpus):
    rows = guard_size(corpus({"c": {"a": "éé", "b": "abc"}}), limit=3).collect()
    assert {r.name: r.error is None for r in rows} == {"a": False, "b": True}
