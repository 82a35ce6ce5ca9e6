"""Inverted file over chunk vectors: cells of directions, whose radii bound what a cell can hold.

A vector of length one lies in the cell of its nearest centre and keeps its distance to it, the
residual. No member of a cell is nearer to a query than the query's distance to the centre less the
greatest residual of that cell and namespace, so the ``k`` nearest are found exactly without
reading cells that are too far away.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semblance.functions.joins import broadcast_if_few, narrow_join
from semblance.operators.vectors import vector_topk
from semblance.session import cut_lineage
from semblance.settings import CELLS, CELL_ROUNDS, CELL_SAMPLE, TOP_K

CHUNK = ["namespace", "name", "chunk_no"]
# Room for the rounding of distances, far above that of doubles.
SLACK = 1e-6


def _unit(vectors: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(lengths > 0, lengths, 1.0)


def _usable(vectors, width: int) -> np.ndarray:
    """Which vectors are given, of this width and finite."""
    return np.array([
        v is not None and len(v) == width and bool(np.isfinite(np.array(v, dtype=float)).all()) for v in vectors
    ], dtype=bool)


def fit_cells(chunks: DataFrame, cells: int = CELLS, sample: int = CELL_SAMPLE, rounds: int = CELL_ROUNDS) -> list[list[float]]:
    """Centres of ``cells`` directions, learned on at most ``sample`` vectors chosen by hash.

    Only the centres come from the sample; the index holds every vector. Fewer distinct vectors
    give fewer centres, none give one centre at zero.
    """
    chosen = chunks.filter("embedding IS NOT NULL").orderBy(F.xxhash64(*CHUNK), *CHUNK).limit(sample)
    rows = [r[0] for r in chosen.select("embedding").collect()]
    width = len(rows[0]) if rows else 0
    rows = [v for v, ok in zip(rows, _usable(rows, width)) if ok]
    if not rows:
        return [[0.0] * width]
    points = np.unique(_unit(np.array(rows, dtype=float)), axis=0)
    points = points[np.random.default_rng(0).permutation(len(points))]
    centres = points[:cells]
    for _ in range(rounds):
        nearest = (points @ centres.T * 2 - (centres ** 2).sum(axis=1)).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres.tolist()


def _distances(centres: Sequence[Sequence[float]]):
    """A function from vectors to their distances to all centres, after scaling to length one."""
    fixed = np.array(centres, dtype=float)

    def to_all(vectors: pd.Series) -> np.ndarray:
        points = _unit(np.stack(vectors.to_numpy()).astype(float))
        squares = (points ** 2).sum(axis=1)[:, None] + (fixed ** 2).sum(axis=1) - 2 * points @ fixed.T
        return np.sqrt(np.maximum(squares, 0.0))

    return to_all


def assign_cells(chunks: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """Chunks with ``cell`` and ``residual``. Chunks whose vector is missing, of another width or not
    finite have neither and are never found."""
    to_all, width = _distances(centres), len(centres[0])

    @F.pandas_udf("cell int, residual double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame({"cell": pd.array([None] * len(vectors), dtype="Int32"), "residual": np.nan})
        given = _usable(vectors, width)
        if given.any():
            far = to_all(vectors[given])
            cell = far.argmin(axis=1)
            found.loc[given, "cell"] = cell
            found.loc[given, "residual"] = far[np.arange(len(far)), cell]
        return found

    return chunks.select("*", nearest("embedding").alias("_at")).select(*chunks.columns, "_at.cell", "_at.residual")


def cell_bounds(index: DataFrame) -> DataFrame:
    """Per namespace and cell: rows and greatest residual. At most one short row per cell in use."""
    return index.filter("cell IS NOT NULL").groupBy("namespace", "cell").agg(
        F.count("*").alias("n"), F.max("residual").alias("radius")
    )


def write_index(chunks: DataFrame, centres: Sequence[Sequence[float]], path: str, mode: str = "append") -> None:
    """Store chunks by cell, so that a search reads the folders of its cells alone. Later chunks
    are appended with the same centres; bounds are taken from what is stored."""
    placed = assign_cells(chunks, centres)
    by_cell = placed.repartition("cell", F.pmod(F.xxhash64(*CHUNK), F.lit(8)))
    by_cell.write.mode(mode).partitionBy("cell").parquet(path)


def _query_cells(queries: DataFrame, centres: Sequence[Sequence[float]], bounds: DataFrame) -> DataFrame:
    """The cells of each query's namespace with the least distance that a member can have."""
    to_all, width = _distances(centres), len(centres[0])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def all_cells(vectors: pd.Series) -> pd.Series:
        given = _usable(vectors, width)
        far = iter(to_all(vectors[given]) if given.any() else ())
        return pd.Series([next(far) if ok else None for ok in given], dtype=object)

    far = queries.select(
        "namespace", "query", F.posexplode(all_cells("embedding")).alias("cell", "distance")
    )
    nearest = far.groupBy("namespace", "query", "cell").agg(F.min("distance").alias("distance"))
    return nearest.join(broadcast_if_few(bounds), ["namespace", "cell"]).withColumn(
        "least", F.greatest(F.col("distance") - F.col("radius") - SLACK, F.lit(0.0))
    )


def _members(index: DataFrame, queries: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest members of the given cells. Namespace and query together are the namespace
    here, so that a row is scored for the queries that visit its cell and for no other."""
    # At most as many numbers as there are centres: the scan opens these cells only.
    used = [r[0] for r in cells.select("cell").distinct().collect()]
    visited = narrow_join(index.filter(F.col("cell").isin(used)), cells.select("namespace", "query", "cell"),
                          ["namespace", "cell"], ["name", "chunk_no"])
    pair = F.struct("namespace", "query").alias("namespace")
    hits = vector_topk(
        visited.select(pair, "name", "chunk_no", "embedding"),
        queries.filter("embedding IS NOT NULL").select(pair, F.lit("").alias("query"), "embedding"), k,
    )
    return hits.select("namespace.namespace", "namespace.query", "name", "chunk_no", "score", "rank")


def visited_cells(index: DataFrame, queries: DataFrame, centres: Sequence[Sequence[float]], k: int = TOP_K) -> DataFrame:
    """``(namespace, query, cell, n)`` that the ``k`` nearest of each query may lie in.

    The nearest cells that hold ``k`` rows together are scored first. Their ``k``-th score bounds
    the distance of all better rows, and cells whose members are farther away are left out.
    """
    bounds = cut_lineage(cell_bounds(index))
    reachable = cut_lineage(_query_cells(queries, centres, bounds))
    nearer = Window.partitionBy("namespace", "query").orderBy("distance", "cell").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(nearer), F.lit(0))
    first = cut_lineage(reachable.withColumn("before", before).filter(F.col("before") < k))
    found = _members(index, queries, first, k).groupBy("namespace", "query").agg(
        F.count("*").alias("held"), F.min("score").alias("worst")
    )
    # Two vectors of length one with the cosine c are sqrt(2 - 2c) apart.
    reach = F.when(F.col("held") >= k, F.sqrt(F.greatest(2.0 - 2.0 * F.col("worst"), F.lit(0.0))))
    return cut_lineage(reachable.join(found, ["namespace", "query"], "left").filter(
        reach.isNull() | (F.col("least") <= reach + SLACK)
    ).select("namespace", "query", "cell", "n"))


def index_topk(index: DataFrame, queries: DataFrame, centres: Sequence[Sequence[float]], k: int = TOP_K) -> DataFrame:
    """The rows of ``vector_topk``, read from the cells that can hold them.

    ``index`` is the stored table of ``write_index`` or the result of ``assign_cells``;
    ``queries(namespace, query, embedding)`` a short list per namespace. A query of length zero is
    equally far from all, so all cells are read for it. Chunks and queries whose vector is missing,
    of another width or not finite take no part.
    """
    return _members(index, queries, visited_cells(index, queries, centres, k), k)
