"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is a row of overlapping windows of words. Each word enters with a word input, its log odds
among labelled texts, and character inputs, pooled log odds of its character n-grams, so that
unseen forms of a word are read by their spelling. A recurrent network reads a window in both
directions, attention pools its states, and the pooled state gives the window's logit. A text's
score is that of its worst window. Labels belong to whole texts, so training turns in rounds: the
windows that now score highest in each text stand for it in the next round. Everything is numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.storage import sample_rows

# Labelled texts of each kind that are learned from, chosen by the hash of their id.
TOXIC_ROWS = 1200
CLEAN_ROWS = 3000
ACCEPT = 0.7
WINDOW = 32
STRIDE = 16
STATES = 8
ATTENTION = 8
GRAMS = (3, 4, 5)
GRAM_BUCKETS = 1 << 16
WORD_BUCKETS = 1 << 16
INPUTS = 7
ROUNDS = 5
PASSES = 4
BATCH = 256
RATE = 0.02
SEED = 77
# Parts of the labelled texts; the word and n-gram odds of one are learned from the others.
FOLDS = 4
# Windows scored at once, and words whose gate inputs a worker keeps.
SCORED_WINDOWS = 1024
CHUNK_WORDS = 60_000
KEPT_WORDS = 100_000
# Texts of an Arrow batch that are Python strings at one time.
ROWS_AT_ONCE = 1024

_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def window_starts(n: int) -> list[int]:
    """Starts of the overlapping windows over ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def spellings(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, n-gram buckets, first n-gram of each word, and word lengths.

    Every word has n-grams: its marks of begin and end count as characters.
    """
    codes = np.frombuffer("".join([f"\x02{w}\x03" for w in words]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(lengths)
    begins = ends - lengths
    left = np.repeat(ends, lengths) - np.arange(len(codes))
    grams, owners = [], []
    owner = np.repeat(np.arange(len(words)), lengths)
    mixed = np.zeros(len(codes), dtype=np.uint64)
    for order in range(1, max(GRAMS) + 1):
        mixed = mixed[: len(codes) - order + 1] * _MIX + codes[order - 1:] + np.uint64(order)
        if order in GRAMS:
            whole = left[: len(mixed)] >= order
            grams.append(((mixed[whole] * _FINISH) >> np.uint64(40)).astype(np.int64) % GRAM_BUCKETS)
            owners.append(owner[: len(mixed)][whole])
    order = np.argsort(np.concatenate(owners), kind="stable")
    owners = np.concatenate(owners)[order]
    # A polynomial over the characters stands for the word; powers run from its begin.
    power = np.cumprod(np.full(int(lengths.max()), _MIX))
    place = np.arange(len(codes)) - np.repeat(begins, lengths)
    whole_word = np.add.reduceat(codes * power[place], begins)
    buckets = ((whole_word * _FINISH) >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
    return buckets, np.concatenate(grams)[order], np.searchsorted(owners, np.arange(len(words))), lengths - 2


def log_odds(with_toxic: np.ndarray, with_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Standardised log odds ratio per bucket of texts that hold it, scaled to about -1 to 1."""
    a, b = with_toxic + 0.5, with_clean + 0.5
    c, d = toxic - with_toxic + 0.5, clean - with_clean + 0.5
    ratio = np.log(a) - np.log(c) - np.log(b) + np.log(d)
    odds = ratio / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d) / 4.0
    return np.where(with_toxic + with_clean > 0, np.clip(odds, -1.5, 1.5), 0.0).astype(np.float32)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters of the recurrent network and the input tables."""

    word_odds: np.ndarray
    gram_odds: np.ndarray
    known: np.ndarray
    weights: dict[str, np.ndarray]
    shift: float = 0.0
    constant: float | None = None
    ids: dict[str, int] = field(default_factory=dict)
    gates: np.ndarray | None = None

    def inputs(self, words: list[str]) -> np.ndarray:
        """Input vector of each word, shape (words, INPUTS)."""
        buckets, grams, first, lengths = spellings(words)
        odds = self.gram_odds[grams]
        count = np.diff(np.append(first, len(grams)))
        return np.stack([
            self.word_odds[buckets], np.maximum.reduceat(odds, first), np.minimum.reduceat(odds, first),
            np.add.reduceat(odds, first) / count, np.add.reduceat((odds > 0.5).astype(np.float32), first) / 4.0,
            self.known[buckets].astype(np.float32), lengths.astype(np.float32) / 12.0,
        ], axis=1).astype(np.float32)

    def gate_inputs(self, x: np.ndarray) -> np.ndarray:
        """Both directions' gate inputs, shape (..., 2, 3 * STATES)."""
        w = self.weights
        return (x @ w["wx"].reshape(INPUTS, -1)).reshape(*x.shape[:-1], 2, 3 * STATES) + w["b"]

    def run(self, gates, index: np.ndarray, mask: np.ndarray | None, keep: list | None = None):
        """States of both directions, shape (steps, 2, windows, STATES), in order of the steps.

        ``gates`` is indexed by word; the second direction reads its words from the end.
        """
        wh = self.weights["wh"]
        steps, n = index.shape
        h = np.zeros((2, n, STATES), dtype=np.float32)
        states = np.empty((steps, 2, n, STATES), dtype=np.float32)
        for t in range(steps):
            gx = np.stack([gates[index[t], 0], gates[index[steps - 1 - t], 1]])
            gh = np.matmul(h, wh)
            zr = sigmoid(gx[..., : 2 * STATES] + gh[..., : 2 * STATES])
            z, r = zr[..., :STATES], zr[..., STATES:]
            inner = gh[..., 2 * STATES:]
            c = np.tanh(gx[..., 2 * STATES:] + r * inner)
            new = c + z * (h - c)
            m = None
            if mask is not None:
                m = np.stack([mask[t], mask[steps - 1 - t]])[..., None]
                new = h + m * (new - h)
            if keep is not None:
                keep.append((h, z, r, c, inner, m))
            h = states[t] = new
        return states

    def pool(self, states: np.ndarray, mask: np.ndarray | None):
        """Attention over the steps: joint states, attention inputs, shares and logits."""
        w = self.weights
        joint = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
        bent = np.tanh(joint @ w["wa"])
        force = bent @ w["va"]
        if mask is not None:
            force = np.where(mask > 0, force, -1e9)
        share = np.exp(force - force.max(axis=0))
        share /= share.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", share, joint)
        return joint, bent, share, pooled, pooled @ w["wo"] + w["bo"][0]

    def logits(self, index: np.ndarray, mask: np.ndarray | None, gates: np.ndarray) -> np.ndarray:
        return self.pool(self.run(gates, index, mask), mask)[-1]

    def slopes(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss; ``x`` has shape (steps, windows, INPUTS)."""
        w, (steps, n, _) = self.weights, x.shape
        gates = self.gate_inputs(x.reshape(steps * n, INPUTS))
        index = np.arange(steps * n).reshape(steps, n)
        kept: list = []
        joint, bent, share, pooled, logit = self.pool(self.run(gates, index, mask, kept), mask)
        d_logit = ((sigmoid(logit) - labels) * weight).astype(np.float32)
        out = {"wo": pooled.T @ d_logit, "bo": np.array([d_logit.sum()])}
        d_pooled = d_logit[:, None] * w["wo"]
        d_share = np.einsum("nk,tnk->tn", d_pooled, joint)
        d_force = share * (d_share - (share * d_share).sum(axis=0))
        out["va"] = np.einsum("tn,tna->a", d_force, bent)
        d_bent = d_force[..., None] * w["va"] * (1 - bent ** 2)
        out["wa"] = np.einsum("tnk,tna->ka", joint, d_bent)
        d_joint = share[..., None] * d_pooled + d_bent @ w["wa"].T
        d_states = np.stack([d_joint[..., :STATES], d_joint[::-1, :, STATES:]], axis=1)
        out["wh"] = np.zeros_like(w["wh"])
        d_gates = np.empty((steps, 2, n, 3 * STATES), dtype=np.float32)
        d_h = np.zeros((2, n, STATES), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, c, inner, m = kept[t]
            d_h = d_h + d_states[t]
            d_new = d_h if m is None else d_h * m
            d_c = d_new * (1 - z) * (1 - c ** 2)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * inner * r * (1 - r)
            d_gates[t] = np.concatenate([d_z, d_r, d_c], axis=-1)
            d_gh = np.concatenate([d_z, d_r, d_c * r], axis=-1)
            out["wh"] += np.matmul(h.transpose(0, 2, 1), d_gh)
            d_h = (0.0 if m is None else d_h * (1 - m)) + d_new * z + np.matmul(d_gh, w["wh"].transpose(0, 2, 1))
        out["b"] = d_gates.sum(axis=(0, 2))
        both = [x, x[::-1]]
        out["wx"] = np.stack([np.einsum("tni,tng->ig", both[k], d_gates[:, k]) for k in (0, 1)], axis=1)
        return out

    def text_logits(self, texts: list[list[str]]) -> np.ndarray:
        """Highest window logit of each text; minus infinity without words."""
        if self.gates is None or len(self.ids) > KEPT_WORDS:
            self.ids.clear()
            if self.gates is None:
                self.gates = np.empty((0, 2, 3 * STATES), dtype=np.float32)
        ids = self.ids
        fresh = [w for w in dict.fromkeys(w for text in texts for w in text) if w not in ids]
        if fresh:
            begin, end = len(ids), len(ids) + len(fresh)
            ids.update(zip(fresh, range(begin, end)))
            if end > len(self.gates):
                grown = np.empty((max(end, 2 * len(self.gates)), 2, 3 * STATES), dtype=np.float32)
                grown[:begin] = self.gates[:begin]
                self.gates = grown
            for at in range(0, len(fresh), 20_000):
                part = fresh[at:at + 20_000]
                self.gates[begin + at:begin + at + len(part)] = self.gate_inputs(self.inputs(part))
        out = np.full(len(texts), -np.inf)
        full, owners = [], []
        for k, text in enumerate(texts):
            if text:
                row = np.fromiter(map(ids.__getitem__, text), dtype=np.int64, count=len(text))
                if len(row) < WINDOW:
                    mask = np.zeros((WINDOW, 1), dtype=np.float32)
                    mask[: len(row)] = 1
                    index = np.zeros((WINDOW, 1), dtype=np.int64)
                    index[: len(row), 0] = row
                    out[k] = self.logits(index, mask, self.gates)[0]
                else:
                    starts = np.array(window_starts(len(row)))
                    full.append(np.lib.stride_tricks.sliding_window_view(row, WINDOW)[starts])
                    owners.append(np.full(len(starts), k))
        if full:
            windows, owner = np.concatenate(full), np.concatenate(owners)
            for at in range(0, len(windows), SCORED_WINDOWS):
                index = np.ascontiguousarray(windows[at:at + SCORED_WINDOWS].T)
                np.maximum.at(out, owner[at:at + SCORED_WINDOWS], self.logits(index, None, self.gates))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score of each text; 0 for a text without words."""
        out, chunk, size, at = np.zeros(len(texts)), [], 0, 0
        if self.constant is not None:
            return np.array([self.constant if words_of(t) else 0.0 for t in texts])
        for k, text in enumerate(texts):
            chunk.append(words_of(text))
            size += len(chunk[-1])
            if size >= CHUNK_WORDS or k == len(texts) - 1:
                out[at:k + 1] = sigmoid(self.text_logits(chunk) + self.shift)
                chunk, size, at = [], 0, k + 1
        return out

    def __getstate__(self):
        return self.__dict__ | {"ids": {}, "gates": None}


def _start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def matrix(*shape):
        return (rng.normal(size=shape) / np.sqrt(shape[-2] if len(shape) > 1 else shape[0])).astype(np.float32)

    return {
        "wx": rng.normal(size=(INPUTS, 2, 3 * STATES)).astype(np.float32) * 0.5, "wh": matrix(2, STATES, 3 * STATES),
        "b": np.zeros((2, 3 * STATES), dtype=np.float32), "wa": matrix(2 * STATES, ATTENTION),
        "va": matrix(ATTENTION, 1)[:, 0], "wo": matrix(2 * STATES, 1)[:, 0], "bo": np.zeros(1, dtype=np.float32),
    }


def fit(texts: list[list[list[str]]], labels: np.ndarray) -> Network:
    """Learn from windows of words of labelled texts; a constant where only one label occurs."""
    pairs = [(t, y) for t, y in zip(texts, labels) if t]
    labels = np.array([y for _, y in pairs], dtype=np.float32)
    texts = [t for t, _ in pairs]
    toxic, clean = int(labels.sum()), int(len(labels) - labels.sum())
    rng = np.random.default_rng(SEED)
    # Texts of each label are dealt to the parts in turn.
    fold = np.where(labels > 0, np.cumsum(labels > 0), np.cumsum(labels <= 0)) % FOLDS
    seen_words, seen_grams = np.zeros((FOLDS, 2, WORD_BUCKETS)), np.zeros((FOLDS, 2, GRAM_BUCKETS))
    counts = np.zeros((FOLDS, 2))
    for k, (text, label) in enumerate(zip(texts, labels)):
        buckets, grams, _, _ = spellings(list({w for window in text for w in window}))
        at = fold[k], int(label)
        seen_words[at][np.unique(buckets)] += 1
        seen_grams[at][np.unique(grams)] += 1
        counts[at] += 1

    def tables(use: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, grams, (clean_n, toxic_n) = seen_words[use].sum(0), seen_grams[use].sum(0), counts[use].sum(0)
        return (
            log_odds(words[1], words[0], toxic_n, clean_n), log_odds(grams[1], grams[0], toxic_n, clean_n),
            words.sum(axis=0) > 1,
        )

    net = Network(*tables(np.ones(FOLDS, dtype=bool)), _start_weights(rng))
    if not toxic or not clean:
        net.constant = 0.0 if not toxic else 1.0
        return net
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for window in t for w in window))}
    names = list(vocabulary)
    # The inputs of a text come from the other folds: its own label must not show in them.
    x_of = np.concatenate([
        Network(*tables(np.arange(FOLDS) != k), {}).inputs(names[at:at + 20_000])
        for k in range(FOLDS) for at in range(0, len(names), 20_000)
    ])
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    index = np.zeros((len(owner), WINDOW), dtype=np.int32)
    mask = np.zeros((len(owner), WINDOW), dtype=np.float32)
    for k, window in enumerate(w for t in texts for w in t):
        index[k, : len(window)] = [vocabulary[w] for w in window]
        mask[k, : len(window)] = 1
    index += (fold[owner] * len(names))[:, None]
    odds = x_of[:, 0] + x_of[:, 1]
    hint = np.where(mask > 0, odds[index], -9).max(axis=1)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.weights.items()}
    step = 0
    for turn in range(ROUNDS + 1):
        if turn:
            hint = np.empty(len(index))
            for at in range(0, len(index), SCORED_WINDOWS):
                part = slice(at, at + SCORED_WINDOWS)
                used, place = np.unique(index[part].T, return_inverse=True)
                gates = net.gate_inputs(x_of[used])
                hint[part] = net.logits(place.reshape(WINDOW, -1), np.ascontiguousarray(mask[part].T), gates)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, hint)
        if turn == ROUNDS:
            break
        # The worst window of each text, and of clean texts also some others.
        top = hint >= best[owner]
        chosen = np.flatnonzero(top | ((labels[owner] == 0) & (rng.random(len(owner)) < 2.0 * len(texts) / len(owner))))
        y = labels[owner[chosen]]
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6)).astype(np.float32)
        for _ in range(PASSES):
            mixed = rng.permutation(len(chosen))
            for at in range(0, len(mixed), BATCH):
                part = mixed[at:at + BATCH]
                rows = chosen[part]
                x = np.ascontiguousarray(x_of[index[rows]].transpose(1, 0, 2))
                found = net.slopes(x, np.ascontiguousarray(mask[rows].T), y[part], weight[part] / len(part))
                norm = np.sqrt(sum(float((g ** 2).sum()) for g in found.values()))
                step += 1
                for k, g in found.items():
                    g = g * min(1.0, 1.0 / max(norm, 1e-9))
                    first, second = moments[k]
                    first += 0.1 * (g - first)
                    second += 0.01 * (g * g - second)
                    move = first / (1 - 0.9 ** step) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-7)
                    net.weights[k] = (net.weights[k] - RATE * move).astype(np.float32)
    # The cut between the labelled texts that errs least comes to lie at the accepting score.
    order = np.argsort(best)
    errors = np.concatenate(([clean], clean + np.cumsum(np.where(labels[order] > 0, 1, -1))))
    places = np.concatenate(([best[order[0]] - 2], (best[order][1:] + best[order][:-1]) / 2, [best[order[-1]] + 2]))
    least = np.flatnonzero(errors == errors.min())
    cut = float(places[least[len(least) // 2]])
    net.shift = float(np.log(ACCEPT / (1 - ACCEPT)) - cut)
    return net


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Network:
    """Learn from ``labels(doc_id, label)`` and all windows of the texts of ``docs(doc_id, text)``.

    Rows without a label teach nothing. At most ``toxic_rows + clean_rows`` labelled texts are used;
    of the rows of one ``doc_id`` one teaches, a toxic one if there is any.
    """
    known = labels.filter("label IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("int"))
    picked = sample_rows(known.filter("label > 0"), "doc_id", toxic_rows).union(
        sample_rows(known.filter("label <= 0"), "doc_id", clean_rows)
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [" ".join(words_of(text)) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rows, pa.string())], ["doc_id", "label", "words"])

    marked = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(
        F.col("doc_id").cast("string"), F.when(F.col("label") > 0, 1).otherwise(0).alias("label"), "text"
    )
    made = marked.mapInArrow(cut, "doc_id string, label int, words string")
    found = made.groupBy("doc_id").agg(F.max(F.struct("label", "words")).alias("row")).select("row.*").collect()
    found.sort(key=lambda r: (r["label"], r["words"]))
    # One string object per distinct word keeps the driver's memory small.
    one: dict[str, str] = {}
    texts = []
    for r in found:
        words = [one.setdefault(w, w) for w in r["words"].split()]
        texts.append([words[s:s + WINDOW] for s in window_starts(len(words))])
    labels = np.array([r["label"] for r in found])
    del found
    return fit(texts, labels)


def _score_batch(model: Network, texts: pa.Array) -> np.ndarray:
    parts = [model.scores(texts.slice(at, ROWS_AT_ONCE).to_pylist()) for at in range(0, len(texts), ROWS_AT_ONCE)]
    return np.round(np.concatenate([np.zeros(0), *parts]), 6)


def score(docs: DataFrame, model: Network, accept: float = ACCEPT) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row of ``docs(doc_id, text)``, over all windows.

    NULL texts and texts without words score 0. Repeated rows and NULL ids keep a row each; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _score_batch(model, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64()), pa.array((found >= accept).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, score double, predicted int"
    )


def not_toxic(docs: DataFrame, model: Network, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``accept``, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score_batch(model, batch.column(at)) < accept))

    return docs.mapInArrow(run, docs.schema)
