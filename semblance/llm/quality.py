"""Text quality by a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Shallow trees on one binned feature at a time are boosted in
turn, round after round, and summed into one lookup table per feature; then the pairs of features
with the most left to explain get tables of their own in the same way. A text is scored by adding
the table entries of its bins.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.storage import sample_rows

# Labelled rows that are learned from, chosen by the hash of their id.
TRAIN_ROWS = 20_000
ACCEPT = 0.7
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 60
RATE = 0.15
LEAF_PENALTY = 1.0
LEAF_WEIGHT = 2.0

FEATURES = (
    "log_words", "word_length", "long_words", "upper", "digits", "stops", "exclaims", "pipes", "symbols",
    "non_ascii", "line_words", "repeated_next", "top_word", "distinct_words", "repeated_lines", "distinct_runs",
    "sentence_words", "marked_words",
)


def features(text: str | None) -> list[float]:
    """Numbers that describe a whole text; defined for an empty one."""
    text = text or ""
    octets = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    seen = np.bincount(octets, minlength=256)
    size = max(len(octets), 1)
    words = text.split()
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    lower, upper = seen[97:123].sum(), seen[65:91].sum()
    letters = lower + upper + seen[128:].sum()
    ends = seen[46] + seen[33] + seen[63]
    stops = ends + seen[44] + seen[58] + seen[59]
    symbols = sum(int(seen[ord(c)]) for c in "#$%&*+/<=>@[\\]^_`{}~|")
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line]
    runs = len(set(zip(words, words[1:], words[2:]))) / (len(words) - 2) if len(words) > 2 else 1.0
    marked = sum(1 for w in counts if not w[-1].isalnum() and w[-1] not in ".,;:")
    return [
        float(np.log1p(len(words))), float(lengths.sum()) / n, float((lengths > 15).sum()) / n,
        upper / max(letters, 1), seen[48:58].sum() / size, stops / n, seen[33] / n, seen[124] / n, symbols / n,
        seen[128:].sum() / size, n / max(len(lines), 1), sum(map(eq, words, words[1:])) / n,
        max(counts.values(), default=0) / n, len(counts) / n,
        1.0 - len(set(lines)) / len(lines) if lines else 0.0, runs, n / (ends + 1.0), marked / max(len(counts), 1),
    ]


def _sums(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(bins, grad, size), np.bincount(bins, hess, size)


def _gain(g, h):
    return g * g / (h + LEAF_PENALTY)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of consecutive bins in two leaves."""
    if len(g) < 2:
        return 0.0, 0
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    rg, rh = g.sum() - lg, h.sum() - lh
    gain = _gain(lg, lh) + _gain(rg, rh) - _gain(g.sum(), h.sum())
    gain[(lh < LEAF_WEIGHT) | (rh < LEAF_WEIGHT)] = 0.0
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values per bin of a tree of at most three leaves."""
    edges = [0, len(g)]
    for _ in range(2):
        gain, cut = max(
            ((gain, a + at) for a, b in zip(edges, edges[1:]) for gain, at in [_best_cut(g[a:b], h[a:b])]),
            default=(0.0, 0),
        )
        if gain <= 1e-9:
            break
        edges = sorted({*edges, cut})
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + LEAF_PENALTY)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts a grid once in each direction."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, grid = 0.0, np.zeros_like(g)
    whole = _gain(cg[-1, -1], ch[-1, -1])
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    right, right_h = cg[:-1, -1:] - a, ch[:-1, -1:] - b
    down, down_h = cg[-1:, :-1] - a, ch[-1:, :-1] - b
    rest, rest_h = cg[-1, -1] - a - right - down, ch[-1, -1] - b - right_h - down_h
    gain = _gain(a, b) + _gain(right, right_h) + _gain(down, down_h) + _gain(rest, rest_h) - whole
    if gain.size:
        i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
        best = float(gain[i, j])
        for rows in (slice(0, i + 1), slice(i + 1, None)):
            for cols in (slice(0, j + 1), slice(j + 1, None)):
                grid[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + LEAF_PENALTY)
    return best, grid


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of features, by adding table entries."""
        total = np.full(len(rows), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], rows[:, k], side="right")]
        for a, b, grid in self.pairs:
            total += grid[
                np.searchsorted(self.coarse[a], rows[:, a], side="right"),
                np.searchsorted(self.coarse[b], rows[:, b], side="right"),
            ]
        return 1.0 / (1.0 + np.exp(-total))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Boosted tables; with one class only, a constant."""
    n = len(labels)
    share = (labels.sum() + 0.5) / (n + 1.0)
    base = float(np.log(share / (1 - share)))
    if n == 0 or labels.min() == labels.max():
        return Model(base, [np.array([])] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [], [])
    edges = [_cuts(rows[:, k], BINS) for k in range(rows.shape[1])]
    bins = [np.searchsorted(e, rows[:, k], side="right") for k, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(len(tables)):
            step = RATE * _shallow_tree(*_sums(bins[k], *slopes(), len(tables[k])))
            tables[k] += step
            total += step[bins[k]]
    coarse = [_cuts(rows[:, k], PAIR_BINS) for k in range(rows.shape[1])]
    few = [np.searchsorted(e, rows[:, k], side="right") for k, e in enumerate(coarse)]

    def grid_sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        g, h = _sums(few[a] * shape[1] + few[b], *slopes(), shape[0] * shape[1])
        return g.reshape(shape), h.reshape(shape)

    ranked = sorted(
        ((_quadrants(*grid_sums(a, b))[0], a, b) for a, b in combinations(range(len(tables)), 2)), reverse=True
    )[:PAIRS]
    pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in ranked]
    for _ in range(PAIR_ROUNDS):
        for a, b, grid in pairs:
            step = RATE * _quadrants(*grid_sums(a, b))[1]
            grid += step
            total += step[few[a], few[b]]
    return Model(base, edges, tables, coarse, pairs)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "label", "features"]
        )


def train(docs: DataFrame, labels: DataFrame, n: int = TRAIN_ROWS) -> Model:
    """Learn from ``labels(doc_id, label)`` and the texts of ``docs(doc_id, text)``.

    Rows without a label teach nothing. At most ``n`` labels are used, so the join side that is
    broadcast is bounded; of the rows of one ``doc_id`` the least one in label and features teaches, so
    at most ``n`` rows of features reach the driver.
    """
    picked = sample_rows(labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "label"), "doc_id", n)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(
        F.col("doc_id").cast("string"), F.col("label").cast("int"), "text"
    )
    made = texts.mapInArrow(_feature_batches, "doc_id string, label int, features array<double>")
    least = made.groupBy("doc_id").agg(F.min(F.struct("label", "features")).alias("row"))
    found = least.select("doc_id", "row.*").orderBy("doc_id").toPandas()
    rows = np.array(found["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit(rows, found["label"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs(doc_id, text)``.

    NULL and empty texts are scored by the features of an empty text. Repeated rows and NULL ids
    keep a row each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t) for t in batch.column(1).to_pylist()], dtype=float)
            scores = model.score(rows.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores), pa.array((scores >= accept).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, score double, predicted int"
    )
