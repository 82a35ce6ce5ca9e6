"""Chunks of whole sentences: as many as fit, each chunk beginning with the last ones of the one before."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semblance.functions.joins import compute_once
from semblance.functions.text import content_hash, tokens
from semblance.operators.corpus import whole_texts
from semblance.session import cut_lineage
from semblance.settings import CHUNK_OVERLAP, CHUNK_TOKENS

# Ship the helpers inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A sentence ends with its marks or its line.
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*|[.!?]+"
TEXT = ["namespace", "name"]


def sentence_units(text: Column, size: int) -> Column:
    """The tokens of each sentence; a sentence above ``size`` tokens is cut into pieces of ``size``."""
    sentences = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0)), tokens)
    kept = F.filter(sentences, lambda s: F.size(s) > 0)
    return F.flatten(F.transform(kept, lambda s: F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(s) / size).cast("int") - 1), lambda i: F.slice(s, i * size + 1, F.lit(size))
    )))


def _pointers(units: DataFrame, size: int, overlap: int) -> DataFrame:
    """``(namespace, name, start, end, next)`` for a chunk that would begin at each unit.

    ``end`` is the first unit that no longer fits. The next chunk begins with the units before it
    that hold at most ``overlap`` tokens and leave room for one unit more. All three are read off
    ranges of token offsets, so no text is walked through.
    """
    sizes = F.concat(F.transform("units", lambda u: F.size(u)), F.array(F.lit(0)))
    rows = units.select(*TEXT, F.posexplode(sizes).alias("unit", "n"))
    before = Window.partitionBy(*TEXT).orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut_lineage(rows.select(*TEXT, "unit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    at = Window.partitionBy(*TEXT).orderBy("offset")
    ranged = placed.select(
        *TEXT, "unit", F.max("unit").over(at.rangeBetween(0, size)).alias("end"),
        F.min("unit").over(at.rangeBetween(-overlap, 0)).alias("within_overlap"),
        F.min("unit").over(at.rangeBetween(-size, 0)).alias("within_size"),
        F.max("unit").over(Window.partitionBy(*TEXT)).alias("last"),
    )
    room = ranged.select(*TEXT, (F.col("unit") - 1).alias("end"), "within_size")
    back = ranged.select(*TEXT, F.col("unit").alias("end"), "within_overlap").join(room, [*TEXT, "end"], "left")
    starts = ranged.filter(F.col("unit") < F.col("last")).select(*TEXT, F.col("unit").alias("start"), "end", "last")
    following = F.greatest("within_overlap", F.coalesce("within_size", F.lit(0)), F.col("start") + 1)
    return starts.join(back, [*TEXT, "end"]).select(
        *TEXT, "start", "end", F.when(F.col("end") < F.col("last"), following).alias("next")
    )


def _windows(size: int, overlap: int):
    """``(start, end)`` of the chunks of each text, from the tokens of its units, walked through once."""

    def run(sizes: pa.Array) -> pa.Array:
        counts = sizes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        tokens = sizes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        starts, ends, found, done = [], [], [0], 0
        for n in counts.tolist():
            offsets = np.concatenate([[0], np.cumsum(tokens[done : done + n])])
            # The first unit that no longer fits after each one; the first of those before it that
            # hold at most ``overlap`` tokens, or that leave room for it.
            reach = (np.searchsorted(offsets, offsets + size, "right") - 1).tolist()
            repeated = np.searchsorted(offsets, offsets - overlap, "left").tolist()
            roomy = np.searchsorted(offsets, offsets - size, "left").tolist()
            start = 0 if n else None
            while start is not None:
                end = reach[start]
                starts.append(start)
                ends.append(end)
                start = max(repeated[end], roomy[end + 1], start + 1) if end < n else None
            found.append(len(starts))
            done += n
        rows = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["start", "end"])
        return pa.ListArray.from_arrays(pa.array(found, pa.int32()), rows)

    return F.arrow_udf(run, "array<struct<start: int, end: int>>")


def sentence_chunks(submissions: DataFrame, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``(namespace, name, chunk_no, content_hash, text)``: windows of at most ``size`` tokens that
    begin and end at sentence borders and repeat at most ``overlap`` tokens.

    A text is walked through where it lies, and only its chunks leave its row. Texts without tokens
    have no chunk; ``corpus_id`` and ``name`` name a text. Where texts share their name they count as
    one, and all units are brought together by windows.
    """
    whole = whole_texts(submissions)
    names = whole.filter(F.col("corpus_id").isNotNull() & F.col("name").isNotNull())
    repeated = names.groupBy("corpus_id", "name").agg(F.count("*").alias("_n")).filter("_n > 1")
    if repeated.isEmpty():
        return _chunks_in_place(_units(names, size), size, overlap)
    return _chunks_by_units(_units(whole, size), size, overlap)


def _units(texts: DataFrame, size: int) -> DataFrame:
    named = texts.select(F.col("corpus_id").alias("namespace"), "name", "raw_text")
    cut = compute_once(named, units=sentence_units(F.col("raw_text"), size)).filter(F.size("units") > 0)
    return cut.select(*TEXT, content_hash(F.col("raw_text")).alias("content_hash"), "units")


def _joined(start: Column, end: Column) -> Column:
    return F.array_join(F.flatten(F.slice("units", start + 1, end - start)), " ")


def _chunks_in_place(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    windows = _windows(size, overlap)(F.transform("units", lambda u: F.size(u)))
    # The chunks are joined inside the row, so that no row takes all units of its text along.
    chunks = texts.withColumn("windows", windows).select(
        *TEXT, "content_hash", F.transform("windows", lambda w: _joined(w["start"], w["end"])).alias("chunks")
    )
    return chunks.select(*TEXT, F.posexplode("chunks").alias("chunk_no", "text"), "content_hash").select(
        *TEXT, "chunk_no", "content_hash", "text"
    )


def _chunks_by_units(texts: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks of texts of which some share their names.

    Which of the possible starts are reached from the begin of the text is found by doubling: each
    round adds what lies one jump behind the starts known, and doubles the jumps.
    """
    texts = cut_lineage(texts)
    pointers = cut_lineage(_pointers(texts, size, overlap))
    longest = pointers.agg(F.max("start")).first()[0] or 0
    reached = pointers.filter("start = 0").select(*TEXT, "start")
    jumps = pointers.filter("next IS NOT NULL").select(*TEXT, "start", "next")
    for _ in range(math.ceil(math.log2(longest + 1)) if longest else 0):
        onward = jumps.withColumnRenamed("next", "start_").join(reached, [*TEXT, "start"]).select(*TEXT, F.col("start_").alias("start"))
        reached = cut_lineage(reached.unionByName(onward).distinct())
        then = jumps.select(*TEXT, F.col("start").alias("next"), F.col("next").alias("then"))
        jumps = cut_lineage(jumps.join(then, [*TEXT, "next"]).select(*TEXT, "start", F.col("then").alias("next")))
    order = Window.partitionBy(*TEXT).orderBy("start")
    chunks = pointers.join(reached, [*TEXT, "start"]).select(
        *TEXT, "start", "end", (F.row_number().over(order) - 1).alias("chunk_no")
    )
    return chunks.join(texts, TEXT).select(*TEXT, "chunk_no", "content_hash", _joined(F.col("start"), F.col("end")).alias("text"))
