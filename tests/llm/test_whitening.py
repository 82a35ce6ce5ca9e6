"""Whitening against a dense eigendecomposition of the exact covariance, and odd rows."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from semblance.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, n int, component string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in enumerate(vectors)], SCHEMA)


def whole(v):
    return [math.floor(64 * c) + 1_000_000 for c in np.float32(v).astype(float)]


def plain(vectors):
    """Count, exact deviations and dense eigenpairs of the distinct rows."""
    rows = [whole(v) for v in vectors]
    distinct = sorted(set(map(tuple, rows)))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    deviation = [sum((n * x - s) ** 2 for x, s in zip(row, sums)) for row in rows]
    centred = np.array([[float(Fraction(n * x - s, n)) for x, s in zip(row, sums)] for row in distinct])
    values, turned = np.linalg.eigh(centred.T @ centred / n)
    away = np.array([[float(Fraction(n * x - s, n)) for x, s in zip(row, sums)] for row in rows])
    return n, deviation, values[::-1], turned[:, ::-1], away


def check(spark, vectors, wanted=16):
    got = W.whiten(table(spark, vectors), wanted).toPandas().sort_values(["component", "vec_id"])
    n, deviation, values, turned, away = plain(vectors)
    k = got["component"].max()
    assert len(got) == k * len(vectors)
    assert set(got["n"]) == {n} and got["identity_error"].max() <= 1e-9 and got["identity_error"].nunique() == 1
    for c in range(k):
        rows = got[got["component"] == c + 1]
        assert rows["deviation"].tolist() == deviation
        assert rows["explained"].to_numpy() == pytest.approx(values[c] / values.sum(), rel=1e-9)
        want = away @ turned[:, c] / np.sqrt(values[c])
        found = rows["whitened"].to_numpy()
        assert np.abs(found - np.sign(found @ want) * want).max() < 1e-7
    return k, values


def test_same_as_dense_eigenvectors(spark):
    random = np.random.default_rng(1)
    vectors = (random.normal(size=(60, 9)) * np.geomspace(3, 0.3, 9)).tolist()
    # A third of all rows are one vector, which counts once.
    assert check(spark, vectors + vectors[:5] + [vectors[0]] * 30, 5)[0] == 5
    assert check(spark, vectors, 16)[0] == 9


def test_directions_without_variance_are_no_components(spark):
    random = np.random.default_rng(2)
    flat = random.normal(size=(40, 3)) @ np.array([[1, 0, 2, 0, 0], [0, 1, 1, 0, 0], [0, 0, 1, 0, 0.0]])
    flat = np.round(flat * 64) / 64
    assert check(spark, flat.tolist())[0] == 3


def test_equal_eigenvalues_are_all_found(spark):
    corners = [[2.0 * (i == k) * s for i in range(6)] for k in range(6) for s in (1, -1)]
    got = W.whiten(table(spark, corners)).toPandas()
    assert got["component"].max() == 6 and got["identity_error"].max() < 1e-9
    assert got["explained"].to_numpy() == pytest.approx(1 / 6, rel=1e-9)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, "a"), (1, [1.0, 0.0], 2, "b"), (None, [0.0, 1.0], 3, "c"), (2, [3.0, 2.0], 4, None),
        (3, None, 5, "d"), (4, [1.0, None], 6, "e"), (5, [nan, 1.0], 7, "f"), (6, [inf, 1.0], 8, "g"), (7, [], 9, "h"),
        (8, [1.0], 10, "i"), (9, [2.0], 11, "j"),
    ]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    wide, narrow = got[got["n"] == 3], got[got["n"] == 2]
    assert sorted(wide["vec_id"].fillna(-1)) == [-1, -1, 1, 1, 1, 1, 2, 2] and sorted(narrow["vec_id"]) == [8, 9]
    assert narrow["explained"].to_numpy() == pytest.approx(1.0) and narrow["deviation"].tolist() == [64 ** 2, 64 ** 2]
    assert W.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, "a")] * 3, SCHEMA)).count() == 0


def test_exact_deviations_beyond_one_long():
    centre = W.Centre(3, [3 * 10 ** 9 + 1, 2])
    x = np.array([[10 ** 9, 0], [2 ** 40, 5]])
    want = [(3 * int(a) - s) ** 2 for row in x for a, s in zip(row, centre.sums)]
    assert centre.deviations(x) == [want[0] + want[1], None]


def test_sums_of_many_tasks(spark, monkeypatch):
    vectors = np.random.default_rng(3).normal(size=(30, 4)).tolist()
    monkeypatch.setattr(W, "DRIVER_ADDS", 0)
    check(spark, vectors)
