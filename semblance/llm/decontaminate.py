"""Benchmark decontamination by size-partitioned MinHash containment search.

Short items hide in documents of any length, so whole documents are too unlike them for MinHash.
Items are partitioned by size; for every partition a document is seen as overlapping windows just
long enough to hold any item of it, which bounds the Jaccard similarity of an item and the window
around it from below. A window and an item that share one of ``HASHES`` minima are a candidate
(at the least similarity that a hit can have, one in 100,000 is missed), and every candidate is
verified by exact containment of the item's word shingles in the whole document.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
HASHES = 32
# Shingles whose minima are taken together; windows consist of such blocks.
BLOCK = 8
# Items are searched in blocks of at most about so many items and bytes; each is one scan.
ITEMS_PER_SCAN = 20_000
BYTES_PER_SCAN = 32 << 20
# Characters of a document that are hashed at once.
SLICE = 1 << 20
SEED = 5
_FILTER_BITS = 16
# Shingles whose minima are computed at once; bounds the memory of a very long text.
_AT_ONCE = 1 << 14
_ROWS = np.arange(HASHES, dtype=np.int64)[:, None] << _FILTER_BITS
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_FINISH = np.uint64(0xD6E8FEB86659FD93)
_FACTORS = (np.random.default_rng(SEED).integers(0, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.array([not 0xD800 <= c < 0xE000 and chr(c).isalnum() for c in range(0x110000)])


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word of a text, all characters at once."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    inside = _alnum()[codes]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False]))))
    begins, lengths = edges[0::2], edges[1::2] - edges[0::2]
    if not len(begins):
        return np.zeros(0, dtype=np.uint64)
    packed = codes[inside].astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(packed)) - np.repeat(starts, lengths)
    power = np.cumprod(np.full(int(lengths.max()), _MIX))
    mixed = np.add.reduceat((packed + np.uint64(1)) * power[place], starts) * _FINISH
    return mixed ^ (mixed >> np.uint64(29))


def document_hashes(text: str) -> np.ndarray:
    """``word_hashes`` of a text of any length, cut at white space into bounded slices."""
    if len(text) <= SLICE:
        return word_hashes(text)
    parts, at = [], 0
    while at < len(text):
        end = min(at + SLICE, len(text))
        while end < len(text) and text[end].isalnum():
            end += 1
        parts.append(word_hashes(text[at:end]))
        at = end
    return np.concatenate(parts)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * _STEP + words[k:k + n]
    out *= _FINISH
    return out ^ (out >> np.uint64(32))


def minima(hashes: np.ndarray, block: int) -> np.ndarray:
    """Minima of every hash function over consecutive blocks, shape (HASHES, blocks)."""
    parts, step = [], max(block, _AT_ONCE // block * block)
    for at in range(0, len(hashes), step):
        mixed = ((hashes[None, at:at + step] * _FACTORS[:, None]) >> np.uint64(32)).astype(np.uint32)
        parts.append(np.minimum.reduceat(mixed, np.arange(0, mixed.shape[1], block), axis=1))
    return np.concatenate(parts, axis=1)


def window_minima(blocks: np.ndarray, width: int) -> np.ndarray:
    """Minima over every run of ``width`` blocks, by doubling; one run if there are fewer."""
    width = min(width, blocks.shape[1])
    size = 1
    while 2 * size <= width:
        blocks = np.minimum(blocks[:, :-size], blocks[:, size:])
        size *= 2
    rest = width - size
    return np.minimum(blocks[:, : blocks.shape[1] - rest], blocks[:, rest:]) if rest else blocks


class ItemIndex:
    """Items of one scan, partitioned by shingle width and number of shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: dict[int, tuple[int | None, int, np.ndarray]] = {}
        found: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for number, (item_id, text) in enumerate(items):
            words = document_hashes(text or "")
            width = min(SHINGLE_WORDS, len(words))
            if width:
                hashes = np.unique(shingles(words, width))
                self.items[number] = (item_id, width, hashes)
                size = 1 if len(hashes) <= BLOCK else 1 << math.ceil(math.log2(len(hashes)))
                found.setdefault((width, size), []).append((number, hashes))
        self.parts = []
        for (width, size), members in sorted(found.items()):
            lookup: dict[int, list[int]] = {}
            marks = np.zeros((HASHES, 1 << _FILTER_BITS), dtype=bool)
            for number, hashes in members:
                low = minima(hashes, len(hashes)).min(axis=1)
                for k, value in enumerate(low.tolist()):
                    lookup.setdefault(k << 32 | value, []).append(number)
                    marks[k, value & ((1 << _FILTER_BITS) - 1)] = True
            self.parts.append((width, size, lookup, marks.reshape(-1)))
        self.widths = sorted({p[0] for p in self.parts})

    def candidates(self, words: np.ndarray) -> set[int]:
        """Items that share a minimum with a window of the document."""
        out: set[int] = set()
        for width in self.widths:
            hashes = shingles(words, width)
            if not len(hashes):
                continue
            blocks = None
            for part_width, size, lookup, marks in self.parts:
                if part_width != width:
                    continue
                if size == 1:
                    # Tiny items: every shingle is a window of its own.
                    lows = minima(hashes, 1)
                else:
                    blocks = minima(hashes, BLOCK) if blocks is None else blocks
                    lows = window_minima(blocks, size // BLOCK + 1)
                rows, places = np.nonzero(marks[_ROWS + (lows & ((1 << _FILTER_BITS) - 1))])
                for key in set((rows << 32 | lows[rows, places]).tolist()):
                    out.update(lookup.get(key, ()))
        return out

    def hits(self, text: str, threshold: float) -> list[tuple[int | None, float]]:
        """``(item_id, containment)`` of the items that a document holds."""
        words = document_hashes(text)
        made = []
        sets: dict[int, np.ndarray] = {}
        for number in sorted(self.candidates(words)):
            item_id, width, hashes = self.items[number]
            if width not in sets:
                sets[width] = np.unique(shingles(words, width))
            share = float(np.isin(hashes, sets[width]).sum()) / len(hashes)
            if share >= threshold:
                made.append((item_id, share))
        return made


def _scan(docs: DataFrame, items: list[tuple[int, str]], threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ItemIndex(items)
        for batch in batches:
            rows = [
                (doc, item, share)
                for doc, text in zip(*(c.to_pylist() for c in batch.columns)) if text
                for item, share in index.hits(text, threshold)
            ]
            kinds = [pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], ["doc_id", "item_id", "containment"]
            )

    return docs.mapInArrow(run, "doc_id long, item_id long, containment double")


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).filter("text IS NOT NULL")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / ITEMS_PER_SCAN), math.ceil(size / BYTES_PER_SCAN))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for k in range(blocks):
        yield [(r["item_id"], r["text"]) for r in rows.filter(place == k).collect()]


def contaminations(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """``(doc_id, item_id, containment)`` of every document that holds an item.

    An item counts as held if at least ``threshold`` of its distinct shingles of five words occur
    in the document; an item of fewer words is one shingle. Items and documents that are NULL,
    empty or without a letter or digit match nothing. Repeated documents and items, and those with
    NULL ids, give a row each; other columns are ignored; clean documents have no row.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for block in item_blocks(items):
        scan = _scan(narrow, block, threshold)
        found = scan if found is None else found.union(scan)
    return found


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, without a shuffle.

    Rows with a NULL text hold nothing and stay.
    """
    at = docs.columns.index("text")

    def without(block: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(block)
            for batch in batches:
                free = [not (text and index.hits(text, threshold)) for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(free, pa.bool_()))

        return run

    for block in item_blocks(items):
        docs = docs.mapInArrow(without(block), docs.schema)
    return docs
