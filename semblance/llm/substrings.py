"""Substring dedup by sliding spans of consecutive sentences.

A text is cut into units: sentences, the clauses of sentences, and pieces of long clauses that end
at the least word hash of a short window, so equal passages are cut alike wherever they stand, and
any 50 words in a row that two texts share hold a whole span. Every unit begins a span: the shortest
run of at least ``SPAN_UNITS`` units with ``SPAN_WORDS`` words. In Chinese, Japanese, Thai and other
scripts without spaces every letter counts as a word, and wide marks need no space after them. Spans are hashed and joined globally;
all units that a non-first occurrence of a repeated span covers are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.storage import free_name, stored

SPAN_UNITS = 3
SPAN_WORDS = 15
# No unit has more words. Of every run of so many words without a clause end, the one of the least
# hash ends a unit, so a cut is told by fewer than so many words on either side. Any 47 shared words
# hold a span: 7 to the first sure cut, 7 to a cut, 24 of the span at most, 9 after the last sure cut.
PIECE_WORDS = 8
# Widths that double a window up to that one.
_HALVES = (1, 2, 4)

# What a character is. White space after a mark or with a line end in it ends a clause, and so does a
# wide mark by itself. Letters of scripts without spaces are words each, with the signs after them.
_SPACE, _MARK, _WIDE, _WIDE_MARK, _SIGN = 1, 2, 3, 4, 5
_KINDS = np.zeros(0x32400, dtype=np.uint8)
_KINDS[[c for c in range(1 << 16) if not chr(c).isalnum()]] = _SIGN
for _a, _b in ((0xE00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3005, 0x3008), (0x3040, 0x3100), (0x31F0, 0x3200),
               (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x20000, 0x323B0)):
    _KINDS[[c for c in range(_a, _b) if chr(c).isalnum()]] = _WIDE
_KINDS[[c for c in range(1 << 16) if chr(c).isspace()]] = _SPACE
_KINDS[[ord(c) for c in ".!?,;:"]] = _MARK
_KINDS[[ord(c) for c in "。！？、，；：．｡､"]] = _WIDE_MARK
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xD6E8FEB86659FD93)
# Stands for a NULL id, which comes after all others.
NO_ID = (1 << 63) - 1


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _starts(codes: np.ndarray) -> np.ndarray:
    kinds = _KINDS[np.minimum(codes, len(_KINDS) - 1)]
    inside = kinds != _SPACE
    begins = inside & ~np.append(False, inside[:-1])
    wide = (kinds == _WIDE) | (kinds == _WIDE_MARK)
    if wide.any():
        # A letter after a wide one or a wide mark, and the signs between, begins a word.
        bare = (kinds != _MARK) & (kinds != _SIGN)
        before = np.maximum.accumulate(np.where(bare | wide, np.arange(len(kinds)), 0))
        after_wide = np.append(False, wide[before[:-1]])
        begins |= (kinds == _WIDE) | ((kinds == 0) & after_wide)
    return np.flatnonzero(begins)


def _ranks(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash above zero of the letters of each word."""
    codes = codes[starts[0]:]
    starts = starts - starts[0]
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(starts, append=len(codes)))
    power = np.cumprod(np.full(int(place.max()) + 1, _MIX))
    letters = np.where(_KINDS[np.minimum(codes, len(_KINDS) - 1)] != _SPACE, codes, 0).astype(np.uint64)
    return ((np.add.reduceat(letters * power[place], starts) * _FINISH) >> np.uint64(33)).astype(np.int64) + 1


def units(text: str) -> list[tuple[str, list[str]]]:
    """``(piece, lower-case words)`` of a text; the pieces joined are the text.

    White space belongs to the unit before it, or to the first unit.
    """
    low = text.lower()
    codes = _codes(text)
    starts = _starts(codes)
    n = len(starts)
    if not n:
        return []
    words = low.split()
    if len(words) != n:
        words = [text[a:b].rstrip().lower() for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(text)])]
    kinds = _KINDS[np.minimum(codes, len(_KINDS) - 1)]
    inside = kinds != _SPACE
    ends = (kinds == _WIDE_MARK) | ((kinds == _MARK) & ~np.append(inside[1:], False))
    last = np.zeros(n, dtype=bool)
    last[np.searchsorted(starts, np.flatnonzero(ends), "right") - 1] = True
    lines = np.searchsorted(starts, np.flatnonzero(codes == 10)) - 1
    last[lines[lines >= 0]] = True
    last[-1] = True
    if n > PIECE_WORDS:
        lowered = _codes(low)
        ranks = _ranks(lowered, starts if len(low) == len(text) else _starts(lowered))
        # Clause ends rank least, so that only windows inside a long clause add a cut; of equal
        # words the last one counts.
        least = (np.where(last, 0, ranks) << 31) + np.arange(n - 1, -1, -1)
        for half in _HALVES:
            least = np.minimum(least[:-half], least[half:])
        last[n - 1 - (least & (1 << 31) - 1)] = True
    cuts = np.flatnonzero(last) + 1
    places = np.append(starts, len(text))[cuts].tolist()
    cuts = cuts.tolist()
    return [
        (text[i:j], words[a:b]) for i, j, a, b in zip([0, *places], places, [0, *cuts], cuts)
    ]


def spans(cut: list[tuple[str, list[str]]]) -> list[tuple[int, int, int]]:
    """``(hash, first unit, unit after the last)`` of the span that begins at each unit."""
    marks = np.array([xxhash.xxh64_intdigest(" ".join(w).encode("utf-8", "surrogatepass")) for _, w in cut], dtype=np.uint64)
    total = np.concatenate(([0], np.cumsum([len(w) for _, w in cut])))
    n = len(cut)
    ends = np.maximum(np.searchsorted(total, total[:-1] + SPAN_WORDS), np.arange(n) + SPAN_UNITS)
    raw = marks.tobytes()
    digest = xxhash.xxh64_intdigest
    return [
        (digest(raw[8 * a:8 * b]) - (1 << 63), a, b) for a, b in enumerate(ends.tolist()) if b <= n
    ]


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, hashes, again = [], [], []

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(hashes, pa.int64()), pa.array(again, pa.bool_())],
                ["doc", "span", "again"],
            )
            for column in (docs, hashes, again):
                column.clear()
            return made

        for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            marks = [mark for mark, _, _ in spans(units(text or ""))]
            distinct = set(marks)
            docs.extend([doc] * len(distinct))
            hashes.extend(distinct)
            again.extend([False] * len(distinct))
            if len(distinct) < len(marks):
                # The text repeats itself, which needs no other text to be told.
                docs.append(doc)
                hashes.append(0)
                again.append(True)
            if len(docs) > 50_000:
                yield rows()
        yield rows()


def _key(column: str):
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``(doc, marks, first_docs)``: spans that a text of a lower id has, too, and these ids.

    A text that only repeats itself has a row without marks.
    """
    found = stored(
        docs.select(_key("doc_id").alias("doc"), "text").mapInArrow(_span_batches, "doc long, span long, again boolean"),
        "spans",
    )
    global_spans = found.filter("NOT again").select("doc", "span")
    shared = global_spans.groupBy("span").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter(
        "first < last"
    ).select("span", "first")
    later = global_spans.join(shared, "span").filter("doc > first").unionByName(
        found.filter("again").select("doc", F.lit(None).cast("long").alias("span"), F.lit(None).cast("long").alias("first"))
    )
    return later.groupBy("doc").agg(F.collect_set("span").alias("marks"), F.collect_set("first").alias("first_docs"))


def covered_units(cut: list[tuple[str, list[str]]], marks: set[int]) -> list[bool]:
    """Which units a repeated span covers: one in ``marks``, or one met before in this text."""
    gone = [False] * len(cut)
    seen = set()
    for mark, a, b in spans(cut):
        if mark in marks or mark in seen:
            gone[a:b] = [True] * (b - a)
        seen.add(mark)
    return gone


def remove_repeats(docs: DataFrame, new: tuple[str, str] = ("n_removed", "first_docs")) -> DataFrame:
    """``docs`` with repeated units cut from ``text``, plus ``n_removed`` and ``first_docs``.

    ``new`` names these columns. The first occurrence is that of the lowest ``doc_id``, and in one
    text the one further left; NULL ids come last. Rows of one ``doc_id`` count as one document
    and do not empty each other. Texts without a repeated span stay as they are to the byte; NULL
    stays NULL; texts below ``SPAN_UNITS`` units or ``SPAN_WORDS`` words have no span. Columns
    called like a new one are replaced, all others pass through.
    """
    kept = [f for f in docs.schema.fields if f.name not in new]
    names = [f.name for f in kept]
    at, n = names.index("text"), len(names)
    key, marked, first = (free_name(docs, c) for c in ("__key", "__marks", "__first"))
    found = repeated_spans(docs).select(
        F.col("doc").alias(key), F.col("marks").alias(marked), F.array_sort("first_docs").alias(first)
    )
    joined = docs.select(*[F.col(f"`{c}`") for c in names], _key("doc_id").alias(key)).join(found, key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                texts, sizes = [], []
                for text, marks in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist()):
                    # Texts without a mark, not even an empty list of them, have nothing to cut.
                    cut = units(text) if text and marks is not None else []
                    gone = covered_units(cut, set(marks or ()))
                    sizes.append(sum(gone))
                    texts.append("".join(p for (p, _), g in zip(cut, gone) if not g) if any(gone) else text)
                columns = list(batch.columns[:n])
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), batch.column(n + 1)], [*names, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    empty = F.array().cast("array<bigint>")
    return joined.select(*[F.col(f"`{c}`") for c in names], marked, F.coalesce(first, empty).alias(first)).mapInArrow(
        run, f"{fields}, `{new[0]}` long, `{new[1]}` array<bigint>"
    )
