"""Nearest neighbours by inner product: stable random projections in kd-trees.

One more component makes all vectors of a shard equally long, so the largest inner product becomes
the least Euclidean distance. A few Gaussian projections of the vectors are indexed by a kd-tree.
A query meets the leaves in order of their projected distance and verifies the vectors in them.
Projected squared distances are true ones times a chi-square variable, so the search stops once
the next leaf lies beyond its quantile times the distance of the worst neighbour kept so far.

Rows are dealt to shards of bounded size by the hash of their id, queries to blocks of bounded
size; each pair of a shard and a block is one group, and the neighbours found are merged by query.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semblance.llm.storage import stored

NEIGHBOURS = 20
QUERY_EVERY = 20
PROJECTIONS = 8
LEAF = 64
# Share of true neighbours inside the chi-square quantile.
CERTAINTY = 0.99
SHARD_ROWS = 4096
QUERY_BLOCK = 4096
# Queries searched at once, and neighbours screened in single precision before the exact ranking.
QUERIES_AT_ONCE = 256
SCREENED = 32
SEED = 11
_FOUND = "query_id long, vec_id long, score double"


def chi_square_quantile(share: float, freedom: int) -> float:
    """Quantile by the cube-root normal approximation."""
    spread = 2.0 / (9.0 * freedom)
    return freedom * (1.0 - spread + NormalDist().inv_cdf(share) * math.sqrt(spread)) ** 3


class ProjectedTree:
    """kd-tree over projections of equally long vectors, as its leaves and their boxes."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        n, width = vectors.shape
        lengths = np.einsum("nd,nd->n", vectors, vectors)
        self.length = math.sqrt(float(lengths.max()))
        self.vectors = vectors.astype(np.float32)
        self.plane = np.random.default_rng(SEED + width).normal(size=(width + 1, PROJECTIONS))
        rest = np.sqrt(np.maximum(self.length ** 2 - lengths, 0.0))
        points = vectors @ self.plane[:-1] + rest[:, None] * self.plane[-1]
        self.leaves: list[np.ndarray] = []
        todo = [np.arange(n)]
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                self.leaves.append(rows)
                continue
            axis = int(np.argmax(np.ptp(points[rows], axis=0)))
            # Split by place, so equal points are parted, too.
            half = len(rows) // 2
            order = np.argpartition(points[rows, axis], half)
            todo += [rows[order[:half]], rows[order[half:]]]
        self.low = np.stack([points[rows].min(axis=0) for rows in self.leaves])
        self.high = np.stack([points[rows].max(axis=0) for rows in self.leaves])
        size = max(map(len, self.leaves))
        self.members = np.stack([np.pad(rows, (0, size - len(rows)), constant_values=-1) for rows in self.leaves])

    def search(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """``(rows, visited)``: rows of the best found per query, -1 where fewer exist."""
        n, leaves = len(queries), len(self.leaves)
        size = np.sqrt(np.einsum("nd,nd->n", queries, queries))
        scaled = queries * (self.length / size)[:, None]
        points = scaled @ self.plane[:-1]
        gap = np.maximum(np.maximum(self.low[None] - points[:, None], points[:, None] - self.high[None]), 0.0)
        away = np.einsum("qlm,qlm->ql", gap, gap)
        order = np.argsort(away, axis=1, kind="stable")
        limit = chi_square_quantile(CERTAINTY, PROJECTIONS)
        asked = scaled.astype(np.float32)
        best = np.full((n, wanted), -np.inf, dtype=np.float32)
        rows = np.full((n, wanted), -1)
        active, visited = np.arange(n), np.zeros(n, dtype=np.int64)
        for turn in range(leaves):
            near = order[active, turn]
            # Squared distance of the worst neighbour kept; infinite until there are enough.
            worst = 2.0 * (self.length ** 2 - best[active, -1].astype(float))
            go = away[active, near] <= limit * np.maximum(worst, 0.0)
            active, near = active[go], near[go]
            if not len(active):
                break
            members = self.members[near]
            made = np.matmul(self.vectors[members], asked[active][:, :, None])[:, :, 0]
            made[members < 0] = -np.inf
            scores = np.concatenate([best[active], made], axis=1)
            places = np.concatenate([rows[active], members], axis=1)
            top = np.argpartition(-scores, wanted - 1, axis=1)[:, :wanted]
            scores = np.take_along_axis(scores, top, axis=1)
            last = np.argsort(-scores, axis=1, kind="stable")
            best[active] = np.take_along_axis(scores, last, axis=1)
            rows[active] = np.take_along_axis(np.take_along_axis(places, top, axis=1), last, axis=1)
            visited[active] += 1
        rows[best == -np.inf] = -1
        return rows, visited


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Double-precision inner products of rows, summed in order of the components."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best rows of a shard for each query, found through its tree."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    # Equal vectors stand in the tree once; their ids, in order, are given out again at the end.
    distinct, kind = np.unique(vectors, axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    by_kind = np.argsort(kind, kind="stable")
    begin = np.searchsorted(kind[by_kind], np.arange(len(distinct) + 1))
    tree = ProjectedTree(distinct)
    found: list[pd.DataFrame] = []
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        part, part_ids = queries[at:at + QUERIES_AT_ONCE], query_ids[at:at + QUERIES_AT_ONCE]
        rows, _ = tree.search(part, max(SCREENED, k + 12))
        who, place = np.nonzero(rows >= 0)
        chosen = rows[who, place]
        scores = inner_products(part[who], distinct[chosen])
        # No more than k + 1 copies of a vector can be wanted, one of them the query itself.
        copies = np.minimum(begin[chosen + 1] - begin[chosen], k + 1)
        spread = np.repeat(np.arange(len(chosen)), copies)
        nth = np.arange(len(spread)) - np.repeat(np.cumsum(copies) - copies, copies)
        rows_of = pd.DataFrame({
            "query_id": part_ids[who[spread]], "vec_id": ids[by_kind[begin[chosen[spread]] + nth]], "score": scores[spread],
        })
        rows_of = rows_of[rows_of["query_id"] != rows_of["vec_id"]]
        rows_of = rows_of.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        found.append(rows_of.groupby("query_id", sort=False).head(k))
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def nearest(embeddings: DataFrame, k: int = NEIGHBOURS, every: int = QUERY_EVERY) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of every query row.

    Queries are the rows of ``embeddings(vec_id, embedding)`` whose ``vec_id`` is divisible by
    ``every``. Vectors that are NULL, empty, zero, or hold NULL or non-finite components take no
    part, nor do rows without ``vec_id``. Rows of one ``vec_id`` count once, with the vector that
    comes first in order. Vectors of different width are not compared. Ties go to the smaller
    ``vec_id``; other columns are ignored; an empty table gives an empty result.
    """
    vector = F.col("embedding").cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(
        vector, lambda x: x != 0
    )
    rows = stored(
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"))
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("width", F.size("embedding")),
        "vectors",
    )
    n, asked = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, blocks = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(asked / QUERY_BLOCK))

    def dealt(name: str, count: int):
        return F.pmod(F.xxhash64(F.lit(name), "vec_id"), F.lit(count)).cast("int").alias(name)

    def all_of(name: str, count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)

    points = rows.select("vec_id", "embedding", "width", dealt("shard", shards), all_of("block", blocks))
    queries = rows.filter(F.col("vec_id") % every == 0).select(
        "vec_id", "embedding", "width", dealt("block", blocks), all_of("shard", shards)
    )
    keys = ["width", "shard", "block"]

    def group(right: pd.DataFrame, left: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search_shard(
            right["vec_id"].to_numpy(), np.stack(right["embedding"].to_numpy()),
            left["vec_id"].to_numpy(), np.stack(left["embedding"].to_numpy()), k,
        )

    found = points.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(group, _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
