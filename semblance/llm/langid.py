"""Language identification by error-correcting output codes.

Every language has a codeword; one binary n-gram classifier per bit tells the languages with a one
from those with a zero. A text's margins are compared with all codewords by loss-weighted
decoding: the codeword with the least logistic loss wins, and a text whose runner-up is almost as
near is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labelled rows per language that are learned from, chosen by the hash of their id.
ROWS_PER_LANGUAGE = 2000
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
# N-grams after which a text's margins no longer grow with its length.
FULL_EVIDENCE = 60
# Difference of scores below which a prediction is flagged.
AMBIGUOUS = 0.2
UNDETERMINED = "und"
# Characters of a text that are hashed at once; bounds the memory of a very long text.
SLICE = 1 << 20
SEED = 20240


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point, itself if it is a letter, else a blank."""
    return np.array([c if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else 32 for c in range(0x110000)], dtype=np.uint32)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the 1- to 3-grams of a text's words; ``None`` without letters."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    text = text or ""
    for at in range(0, len(text), SLICE):
        piece = text[max(at - 2, 0):at + SLICE].lower().encode("utf-32-le", "surrogatepass")
        codes = _letters()[np.frombuffer(piece, dtype="<u4")]
        kept = codes != 32
        kept[1:] |= kept[:-1].copy()
        codes = codes[kept]
        if not len(codes):
            continue
        codes = np.pad(codes, (1, int(codes[-1] != 32)), constant_values=32).astype(np.uint64)
        mixed = np.zeros(len(codes), dtype=np.uint64)
        for order in range(1, max(ORDERS) + 1):
            mixed = mixed[: len(codes) - order + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[order - 1:] + np.uint64(order)
            if order in ORDERS:
                hashed = (mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
                total += np.bincount(hashed.astype(np.int64), minlength=BUCKETS)
    return total if total.any() else None


def codewords(n: int) -> np.ndarray:
    """``n`` codewords of +1 and -1: all splits of up to five classes, else far random ones."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        columns = [(1, *bits) for bits in product((1, -1), repeat=n - 1) if -1 in bits]
        return np.array(columns, dtype=float).T
    rng = np.random.default_rng(SEED)
    width = int(np.ceil(10 * np.log2(n)))
    best, least = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, width))
        code[:, np.abs(code.sum(axis=0)) == n] = rng.permutation(np.arange(n) % 2 * 2.0 - 1)[:, None]
        apart = (width - code @ code.T) / 2 + width * np.eye(n)
        if apart.min() > least:
            best, least = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of belief in each language."""
        n = counts.sum()
        margins = counts @ self.weights / n * min(n, FULL_EVIDENCE) / 3.0
        losses = np.logaddexp(0.0, -self.codes * margins).mean(axis=1)
        belief = np.exp(-(losses - losses.min()) * self.codes.shape[1] / 2)
        return belief / belief.sum()


def fit(per_language: dict[str, np.ndarray]) -> Model:
    """Bit classifiers from the n-gram counts of each language.

    A bit's weight of an n-gram is the log ratio of its smoothed shares in the languages with a
    one and in those with a zero; every language counts alike, however many rows it has.
    """
    languages = sorted(per_language)
    codes = codewords(len(languages))
    weights = np.zeros((BUCKETS, codes.shape[1]))
    if len(languages) > 1:
        shares = []
        for language in languages:
            counts = per_language[language].astype(float) + 0.05
            shares.append(counts / counts.sum())
        shares = np.array(shares)
        for bit in range(codes.shape[1]):
            ones, zeros = shares[codes[:, bit] > 0], shares[codes[:, bit] < 0]
            weights[:, bit] = np.log(ones.mean(axis=0)) - np.log(zeros.mean(axis=0))
        weights = np.clip(weights, -4, 4)
    return Model(languages, codes, weights.astype(np.float32))


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from ``docs(doc_id, text, lang)``; rows without a language teach nothing.

    At most about ``rows_per_language`` rows of each language are read for it. Only counts reach
    the driver, one fixed-size row per language and task.
    """
    known = docs.filter("lang IS NOT NULL")
    sizes = known.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return fit({})
    share = F.create_map(*[
        x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, rows_per_language / r["count"])))
    ])
    chance = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(chance < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts = gram_counts(text)
                if counts is not None:
                    # A long text teaches no more than a text of a thousand n-grams.
                    counts = counts * min(1.0, 1000.0 / counts.sum())
                    totals[language] = totals.get(language, 0) + counts
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), pa.string()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))],
            ["lang", "counts"],
        )

    merged: dict[str, np.ndarray] = {}
    rows = sample.repartition(6).mapInArrow(count, "lang string, counts array<double>")
    for row in rows.toLocalIterator():
        merged[row["lang"]] = merged.get(row["lang"], 0) + np.array(row["counts"])
    return fit(merged)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, runner_up, ambiguous)`` of every row of ``docs(doc_id, text)``.

    A NULL text, one without a letter, and every text under a model without languages are ``und``
    with score 0. Repeated rows and NULL ids keep a row each; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text in batch.column(1).to_pylist():
                counts = gram_counts(text) if model.languages else None
                if counts is None:
                    made.append((UNDETERMINED, 0.0, None, False))
                    continue
                scores = model.scores(counts)
                order = np.argsort(-scores, kind="stable")
                second = float(scores[order[1]]) if len(order) > 1 else 0.0
                made.append((
                    model.languages[order[0]], float(scores[order[0]]),
                    model.languages[order[1]] if len(order) > 1 else None,
                    float(scores[order[0]]) - second < AMBIGUOUS,
                ))
            kinds = [pa.string(), pa.float64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([m[i] for m in made], kinds[i]) for i in range(4))],
                ["doc_id", "lang_pred", "score", "runner_up", "ambiguous"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, runner_up string, ambiguous boolean"
    )
