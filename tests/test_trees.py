"""Trees and pq-grams by a plain recursive build, and what moves the score."""

import random
import re

from semblance.functions import trees as T
from semblance.operators import pairs as P
from semblance.operators import trees as O


def nested(rng, depth=0):
    return (rng.choice("abcd"), [nested(rng, depth + 1) for _ in range(rng.randint(0, 3 if depth < 3 else 0))])


def written(node, pad=0):
    label, below = node
    return ["\n" + " " * pad, label] + [x for child in below for x in written(child, pad + 2 + pad % 3)]


def plain(forest):
    out = []

    def visit(above, label, below):
        row = ["*", "*"] + [c[0] for c in below] + ["*", "*"] if below else ["*", "*", "*"]
        out.extend(f"{above} {label} {' '.join(row[k:k + 3])}" for k in range(len(row) - 2))
        for child in below:
            visit(label, *child)

    visit("*", "*", forest)
    return sorted(out)


def test_grams_of_indented_trees():
    rng = random.Random(3)
    for _ in range(100):
        forest = [nested(rng) for _ in range(rng.randint(1, 3))]
        items = [x for tree in forest for x in written(tree)]
        assert sorted(T.pq_grams(items)) == plain(forest)


def test_brackets_and_lines():
    items = ["\n", "def", "f", "(", "a", "\n      ", "b", ")", ":", "\n", "\n  ", "return", "a", "\n", "end", ")", "x"]
    labels, depths = T.depths(items)
    assert list(zip(labels, depths)) == [
        ("def", 0), ("f", 1), ("(", 1), ("a", 2), ("b", 2), (")", 1), (":", 1), ("return", 1), ("a", 2), ("end", 0), (")", 1), ("x", 1),
    ]
    assert T.pq_grams([]) == T.pq_grams(["\n", "\n  "]) == []


def scores(spark, corpus, texts):
    subs = corpus({"c": texts})
    return {r["other"]: r["tree"] for r in O.tree_scores(subs, P.default_targets(subs)).collect()}


def test_nesting_and_moved_blocks_lower_the_score(spark, corpus):
    code = "def f(a):\n    if a > 1:\n        for x in a:\n            g(x)\n        return h(a)\n    return 2\n\ndef k():\n    while 1:\n        g(3)\n"
    got = scores(spark, corpus, {
        "t": code, "renamed": re.sub(r"\ba\b", "value", code), "comments": code.replace("\n    return 2", "  # why\n\n    return 2"),
        "swapped": code.replace("if a > 1", "@").replace("for x in a", "if a > 1").replace("@", "for x in a"),
        "moved": code.replace("        for x in a:\n            g(x)\n", "").replace("        g(3)\n", "        g(3)\n        for x in a:\n            g(x)\n"),
        "flat": code.replace("    ", ""), "empty": "", "none": None,
    })
    assert got["renamed"] == got["comments"] == 1.0
    assert all(0 < got[k] < 1 for k in ("swapped", "moved", "flat"))
    assert got["empty"] == got["none"] == 0.0


def test_no_rows(spark, corpus):
    subs = corpus({"c": {"t": "a"}}).limit(0)
    assert O.tree_scores(subs, P.default_targets(subs)).count() == 0
