"""SimHash near-duplicates: bit-sliced comparison inside exact candidate buckets.

Two fingerprints that differ in at most ``r`` of their bits agree on at least two of ``r + 2``
blocks of bits. A bucket holds the fingerprints that agree on two chosen blocks. Inside a bucket
the remaining bits are stored as vertical bit planes, and one fingerprint is compared with all
others at once: carry-save counters hold all distances, and the bucket is left as soon as every
distance is above the radius. A bucket above ``BUCKET`` fingerprints is dealt again by two blocks
of its own remaining bits; as fingerprints in a bucket are distinct, a few levels always suffice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.components import components
from semblance.llm.storage import free_name, stored

BITS = 64
RADIUS = 2
SHINGLE_WORDS = 3
HASH_SEED = 42
# Fingerprints that one bucket may hold before it is dealt again by more bits; 16 at least, as
# the last level leaves four bits free.
BUCKET = 128
# Shingles hashed at once; bounds the memory of a very long text.
SLICE = 1 << 16

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of the word shingles of a text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[width - 1:] if len(words) >= width else ends[-1:]
    counts = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    n = len(last)
    for at in range(0, n, SLICE):
        spans = zip(starts[at:min(at + SLICE, n)].tolist(), last[at:at + SLICE].tolist())
        hashes = np.array([digest(joined[s:e], HASH_SEED) for s, e in spans], dtype=np.uint64)
        octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        for k in range(8):
            counts[8 * k:8 * k + 8] += np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS
    bits = (2 * counts > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "text_key", "fp"]
        )


def text_key():
    """Key of a text that tells rows of one id apart."""
    return F.xxhash64("text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, fp)`` of every row of ``docs(doc_id, text)``, whole texts."""
    return docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text").mapInArrow(
        _fingerprint_batches, "doc_id long, text_key long, fp long"
    )


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def refined_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """Masks that add two of ``radius + 2`` blocks of the bits that ``mask`` leaves free."""
    free = [p for p in range(BITS) if not mask >> p & 1]
    blocks = [0] * (radius + 2)
    for i, p in enumerate(free):
        blocks[i * len(blocks) // len(free)] |= 1 << p
    return [mask | a | b for a, b in combinations(blocks, 2)]


def near_lanes(values: list[int], mask: int, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Index pairs of a bucket within the radius, by bit planes and carry-save counters.

    Values are unsigned and agree on ``mask``. A counter of ``k`` bits starts at
    ``2**k - 1 - radius``, so a carry out of it marks a lane above the radius.
    """
    n = len(values)
    full = (1 << n) - 1
    planes = []
    for p in range(BITS):
        if not mask >> p & 1:
            plane = 0
            for lane, value in enumerate(values):
                plane |= (value >> p & 1) << lane
            if plane and plane != full:
                planes.append((p, plane))
    width = radius.bit_length()
    begin = (1 << width) - 1 - radius
    for q in range(n - 1):
        wanted = full & ~((1 << (q + 1)) - 1)
        counter = [full if begin >> k & 1 else 0 for k in range(width)]
        beyond = 0
        for p, plane in planes:
            carry = plane ^ full if values[q] >> p & 1 else plane
            for k in range(width):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            beyond |= carry
            if not wanted & ~beyond:
                break
        near = wanted & ~beyond
        while near:
            low = near & -near
            yield q, low.bit_length() - 1
            near ^= low


def _bucket_links(values: list[int], mask: int, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join what lies within the radius inside one bucket: a spanning forest."""
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    unsigned = [v & ((1 << 64) - 1) for v in values]
    for a, b in near_lanes(unsigned, mask & ((1 << 64) - 1), radius):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            yield values[a], values[b]


def _link_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, bucket, out = None, [], []

        def flush() -> None:
            if len(bucket) > 1:
                out.extend(_bucket_links(bucket, key[0], radius))

        def rows() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"]
            )
            out.clear()
            return made

        for batch in batches:
            for mask, value, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if (mask, value) != key:
                    flush()
                    key, bucket = (mask, value), []
                bucket.append(fp)
            if len(out) > 10_000:
                yield rows()
        flush()
        yield rows()

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fps(fp)`` of distinct fingerprints -> ``(a, b)`` links that connect all within the radius."""
    spark = fps.sparkSession
    masks = {0: refined_masks(0, radius)}
    rows = fps.select(F.lit(0).cast("long").alias("mask"), "fp")
    found = None
    while True:
        spread = F.create_map(*[
            x for m, finer in masks.items()
            for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in finer]))
        ])
        rows = rows.select(F.explode(spread[F.col("mask")]).alias("mask"), "fp").withColumn(
            "value", F.col("fp").bitwiseAND(F.col("mask"))
        )
        sizes = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).filter("n > 1")
        sized = stored(rows.join(sizes, ["mask", "value"]), "buckets")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        level = stored(
            sized.filter(F.col("n") <= BUCKET).select("mask", "value", "fp")
            .repartition(parts, "mask", "value").sortWithinPartitions("mask", "value", "fp")
            .mapInArrow(_link_batches(radius), "a long, b long").distinct(),
            "links",
        )
        found = level if found is None else found.union(level)
        rows = sized.filter(F.col("n") > BUCKET).select("mask", "fp")
        if rows.isEmpty():
            return found
        masks = {f: refined_masks(f, radius) for m in masks.values() for f in m}


def classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, text_key, fp, component, component_id)`` of every row of ``docs(doc_id, text)``.

    ``component`` is the smallest fingerprint reachable, ``component_id`` the smallest ``doc_id``.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    joined = components(links(distinct.select("fp"), radius))
    labelled = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(labelled.select("fp", "component").join(names, "component"), "fp")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row of ``docs(doc_id, text)``.

    Copies share a fingerprint and are collapsed before anything is compared. A NULL or wordless
    text has fingerprint zero and is linked like any other; rows of one ``doc_id`` keep a row each;
    a row with a NULL ``doc_id`` keeps its row and takes part, but never names a component. Other
    columns are ignored; an empty table gives an empty result.
    """
    return classes(docs, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, with all its columns.

    The row of the smallest ``doc_id`` stays, NULL ids last, and of several texts under one id the
    one of the smallest key. Rows with the same id and text are one; which of them stays, where other
    columns differ, is left to Spark.
    """
    order = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.col("text_key"))
    best = classes(docs, radius).groupBy("component").agg(F.min(order).alias("best"))
    keep = best.select(F.col("best.doc_id").alias("__id"), F.col("best.text_key").alias("__text"))
    key, chosen_id, chosen_text = (free_name(docs, n) for n in ("__key", "__id", "__text"))
    keep = keep.toDF(chosen_id, chosen_text)
    keyed = docs.withColumn(key, text_key())
    kept = keyed.join(
        keep, F.col("doc_id").eqNullSafe(F.col(chosen_id)) & (F.col(key) == F.col(chosen_text)), "left_semi"
    )
    return kept.dropDuplicates(["doc_id", key]).drop(key)
