"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Products of the centred rows with a vector and of their transpose with the result take turns, each
one pass over the stored rows. Every left vector is a fixed combination of the columns of the
centred rows, so it is named by as many numbers as a row has and is computed again beside each row
where it is needed: nothing as long as the table leaves the tasks. Both sides are fully
reorthogonalised. The singular values of the small bidiagonal matrix are the deviations along the
components, its right vectors turn the Lanczos vectors into the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.llm.storage import stored

COMPONENTS = 16
# A whole number is floor(SCALE * entry) + OFFSET.
SCALE = 64
OFFSET = 1_000_000
# Larger whole numbers saturate, so that sums over a batch stay exact.
SATURATED = 2 ** 40
# Rounding of one product beside the largest singular value; smaller values count as zero.
ROUNDING = 1e-14
SEED = 13
# Sums of so many tasks may reach the driver; of more tasks, Spark adds them up.
DRIVER_ADDS = 512
_LONG = 2 ** 63 - 1


def sound(vector: Column) -> Column:
    """True for arrays without NULL and non-finite entries; NULL arrays are not sound."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def whole_numbers(vector: Column) -> Column:
    """``floor(SCALE * entry) + OFFSET`` of every entry as long."""
    bound = float(SATURATED)
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(bound)), F.lit(-bound))) + OFFSET)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a batch as a matrix of whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Centre:
    """Count and exact sums of the fit list. A row minus the mean is ``x - whole - part / n``."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.part = np.array([s % self.n for s in self.sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.part / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of ``(n * x - S) ** 2``; None where a long cannot hold one."""
        away = x - self.whole
        reach = (int(np.abs(away).max(initial=0)) + 1) * self.n
        if reach * reach * max(1, x.shape[1]) <= _LONG:
            made = away * self.n - self.part
            return np.einsum("nd,nd->n", made, made).tolist()
        wide = away.astype(object) * self.n - self.part.astype(object)
        return [s if (s := int((row * row).sum())) <= _LONG else None for row in wide]


@dataclass
class Whitening:
    """Unit components as columns by falling eigenvalue, eigenvalues, and the trace of the covariance."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / np.sqrt(self.eigenvalues)


@dataclass
class FitList:
    """A stored list of distinct rows ``x`` of ``width`` whole numbers."""

    rows: DataFrame
    width: int

    def __post_init__(self):
        self.tasks = self.rows.rdd.getNumPartitions()

    def sums(self, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over all rows of ``part(rows)``, an array of ``size`` numbers per batch.

        A task adds up its batches. The driver adds up a bounded number of tasks, Spark any more.
        """
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    total += part(matrix(batch.column(0), width))
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["sums"])

        made = self.rows.select("x").mapInArrow(run, "sums array<double>")
        if self.tasks > DRIVER_ADDS:
            placed = made.select(F.posexplode("sums").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value"))
            made = placed.agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("s")).select(F.col("s.value"))
        return np.array([row[0] for row in made.collect()]).reshape(-1, size).sum(axis=0)


def _centre(fit: FitList) -> Centre:
    width = fit.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * width, 0
        for batch in batches:
            if batch.num_rows:
                total = [a + b for a, b in zip(total, matrix(batch.column(0), width).sum(axis=0).tolist())]
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width + 1), pa.int32()), pa.array([str(s) for s in [*total, n]])], ["place", "value"]
        )

    rows = fit.rows.select("x").mapInArrow(run, "place int, value string").groupBy("place").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value")
    ).collect()
    found = {r["place"]: int(r["value"]) for r in rows}
    return Centre(found[width], [found[k] for k in range(width)])


def _away_from(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Part of a vector orthogonal to the columns of ``basis``; two rounds reach rounding."""
    for _ in range(2):
        vector = vector - basis @ (basis.T @ vector)
    return vector


def bidiagonalise(fit: FitList, centre: Centre, wanted: int) -> Whitening:
    """The ``wanted`` leading components of the rows ``x`` of a stored fit list.

    It stops when the wanted singular triplets have converged to rounding and the variance left
    unexplained is below the last of them, so that none can have been missed; at the latest after
    as many steps as a row has entries. Where a Krylov space ends early, as with equal
    eigenvalues, it goes on from a new vector orthogonal to all before.
    """
    width = len(centre.sums)
    random = np.random.default_rng(SEED)
    right, left, images = (np.zeros((width, 0)) for _ in range(3))
    alphas: list[float] = []
    betas: list[float] = []
    total = fit.sums(1, lambda x: np.array([np.square(centre.centred(x)).sum()]))[0]
    vector = random.normal(size=width)
    vector /= np.linalg.norm(vector)

    def project(side: np.ndarray, by: np.ndarray, back: bool) -> np.ndarray:
        """Of ``p = X by``: its square, its products with all left vectors and, if asked, ``Xᵀ p``."""
        k = side.shape[1]

        def part(x: np.ndarray) -> np.ndarray:
            rows = centre.centred(x)
            p = rows @ by
            found = np.zeros(1 + 2 * width)
            found[0] = p @ p
            found[1:1 + k] = side.T @ (rows.T @ p) if back else (rows @ side).T @ p
            if back:
                found[1 + width:] = rows.T @ p
            return found

        return fit.sums(1 + 2 * width, part)

    while True:
        k = right.shape[1]
        # X v, made orthogonal to the left vectors there are: u = X (v - W c) / alpha.
        made = project(left, vector, False)
        overlap = made[1:1 + k]
        alpha = float(np.sqrt(max(made[0] - overlap @ overlap, 0.0)))
        weight = vector - left @ overlap
        # Xᵀ u, with what rounding has left along the other left vectors taken out.
        made = project(left, weight, True)
        rest, image = made[1:1 + k], made[1 + width:]
        alpha = float(np.sqrt(max(made[0] - rest @ rest, 0.0)))
        largest = max([alpha, *alphas], default=0.0)
        if alpha > ROUNDING * max(largest, np.sqrt(total)):
            weight, image = (weight - left @ rest) / alpha, (image - images @ rest) / alpha
        else:
            alpha, weight, image = 0.0, np.zeros(width), np.zeros(width)
        right, left = np.column_stack([right, vector]), np.column_stack([left, weight])
        images = np.column_stack([images, image])
        alphas.append(alpha)
        residual = _away_from(image, right)
        beta = float(np.linalg.norm(residual))
        bidiagonal = np.diag(alphas) + np.diag(betas, 1)
        small_left, values, small_right = np.linalg.svd(bidiagonal)
        if k + 1 == width:
            break
        converged = k + 1 >= wanted and np.all(beta * np.abs(small_left[-1, :wanted]) <= ROUNDING * values[0])
        if converged and total - np.square(values).sum() < np.square(values[wanted - 1]):
            break
        if beta <= ROUNDING * np.sqrt(total):
            beta, residual = 0.0, _away_from(random.normal(size=width), right)
        vector = _away_from(residual / np.linalg.norm(residual), right)
        vector /= np.linalg.norm(vector)
        betas.append(beta)
    kept = values[:wanted] > ROUNDING * width * np.sqrt(max(total, 1e-300))
    components = right @ small_right[:wanted].T[:, kept]
    return Whitening(
        centre, components / np.linalg.norm(components, axis=0), np.square(values[:wanted][kept]) / centre.n, total / centre.n
    )


def identity_error(fit: FitList, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0

    def part(x: np.ndarray) -> np.ndarray:
        rows = model.whitened(x)
        return np.concatenate([(rows.T @ rows).ravel(), rows.sum(axis=0)])

    made = fit.sums(k * k + k, part)
    mean = made[k * k:] / model.centre.n
    covariance = made[:k * k].reshape(k, k) / model.centre.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def fit_components(rows: DataFrame, width: int, wanted: int = COMPONENTS) -> Whitening:
    """Learn from a stored list ``rows(x)`` of distinct whole-number rows, at least one, of ``width`` entries."""
    fit = FitList(rows, width)
    model = bidiagonalise(fit, _centre(fit), min(wanted, width))
    model.identity_error = identity_error(fit, model)
    return model


_WHITENED = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """Every row of ``rows(vec_id, x)`` along every component."""
    k, width = len(model.eigenvalues), len(model.centre.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.centre.n), pa.int64()),
                    pa.array([d for d in model.centre.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(model.eigenvalues / max(model.trace, 1e-300), m)),
                    pa.array(np.full(m * k, model.identity_error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "x").mapInArrow(run, _WHITENED)


def whiten(embeddings: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of each row.

    ``embeddings(vec_id, embedding)``; rows whose vector is NULL, empty, or holds NULL or
    non-finite entries are dropped. A row without ``vec_id`` and repeated rows keep their rows;
    in the fit each distinct vector of whole numbers counts once. Vectors of different width live
    in spaces of their own, each with its own fit. Directions without variance are no components,
    so a single distinct vector, and an empty table, give no rows. Whole numbers beyond 2^40
    saturate, and a deviation beyond a long is NULL. Other columns are ignored.
    """
    vector = F.col("embedding").cast("array<double>")
    rows = stored(
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"))
        .filter(sound(F.col("embedding")) & (F.size("embedding") > 0))
        .select("vec_id", whole_numbers(F.col("embedding")).alias("x")),
        "whole-vectors",
    )
    empty = embeddings.sparkSession.createDataFrame([], _WHITENED)
    out = None
    for row in rows.groupBy(F.size("x").alias("width")).count().orderBy("width").toLocalIterator():
        same = rows.filter(F.size("x") == row["width"])
        model = fit_components(stored(same.select("x").distinct(), "fit-list"), row["width"], wanted)
        made = apply(same, model)
        out = made if out is None else out.unionByName(made)
    return empty if out is None else out
