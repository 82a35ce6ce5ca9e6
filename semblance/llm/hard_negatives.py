"""Hard negatives by coordinate pruning in buckets of vectors of like length.

The rows of a label are sorted by length and packed into buckets; a bucket holds its vectors, the
values of each coordinate of the unit vectors in order, and which row each value belongs to. An
inner product above a bound is an angle below a bound for all vectors of a bucket. In each focus
coordinate of an anchor, its largest ones, that angle leaves a range of feasible values, and the
rows of these ranges are intersected before the exact scores are taken. A bucket whose longest
vector cannot reach the bound is skipped. The bound rises with what an anchor has found so far.

Buckets are rows of a stored table and anchors come to them in blocks, so vectors are moved once,
to be sorted. An anchor meets the buckets of its own label for its positives, then those of the
other labels for the negatives of each positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semblance.llm.storage import new_folder, stored

POSITIVES = 5
NEGATIVES = 3
ANCHOR_EVERY = 50
SCALE = 256
# Fixed by the task: a label moves on by one, modulo ten, for ids divisible by seven.
MOVED_EVERY = 7
LABELS = 10
# Rows of a bucket, and bytes its vectors may take at most.
BUCKET_ROWS = 2048
BUCKET_BYTES = 4 * 1024 * 1024
FOCUS = 4
# A range of more rows than this share of its bucket is no shorter than the bucket itself.
DENSE_SHARE = 0.25
ANCHORS_AT_ONCE = 256
# Bytes of the anchors that one job brings to the buckets.
BLOCK_BYTES = 8 * 1024 * 1024
# Bytes of vectors in a task, where there are tasks enough; fewer where cores would lie idle.
TASK_BYTES = 64 * 1024 * 1024
LEAST_TASK_BYTES = 2 * 1024 * 1024
# Feasible ranges are widened by this much against rounding.
SLACK = 1e-7
_LEAST = -(2 ** 62)
_EXACT = 2.0 ** 52


def whole_numbers(vector: Column) -> Column:
    """``floor(SCALE * component)`` as long, saturated so that a score fits into a long."""
    bound = F.floor(F.sqrt(F.lit(float(2 ** 61)) / F.greatest(F.size(vector), F.lit(1)))).cast("double")
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c * SCALE, bound), -bound)))


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(rows.astype(float)).sum(axis=1))


def units(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(lengths(rows), 1e-300)[:, None]


def coordinate_order(rows: np.ndarray) -> np.ndarray:
    """The places of the rows in order of each coordinate of their unit vectors."""
    return np.argsort(units(rows).T, axis=1, kind="stable").astype(np.int16)


@dataclass
class Bucket:
    """Rows of one label and like length, longest first, with their sorted coordinate lists."""

    label: int
    ids: np.ndarray
    rows: np.ndarray
    order: np.ndarray

    def __post_init__(self):
        self.longest = float(lengths(self.rows[:1])[0])
        self.values = np.take_along_axis(units(self.rows).T, self.order, axis=1)
        self.places = np.empty_like(self.order)
        np.put_along_axis(self.places, self.order, np.arange(len(self.ids), dtype=self.order.dtype)[None], axis=1)

    def scores(self, anchors: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """Exact inner products of anchors with all rows, or with some."""
        chosen = self.rows if rows is None else self.rows[rows]
        # Exact in double precision where no sum can exceed its whole numbers.
        if self.longest * float(lengths(anchors).max(initial=0)) < _EXACT:
            return (anchors.astype(float) @ chosen.astype(float).T).astype(np.int64)
        return anchors @ chosen.T


def feasible(unit: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of the values that a unit vector within an angle of another can have in a coordinate.

    ``unit`` is the value of the other in it, ``cosine`` that of the angle.
    """
    at, reach = np.arccos(np.clip(unit, -1, 1)), np.arccos(np.clip(cosine, -1, 1))
    return np.cos(np.minimum(at + reach, np.pi)) - SLACK, np.cos(np.maximum(at - reach, 0.0)) + SLACK


@dataclass
class Anchors:
    """A block of anchors, each with one or more bands ``low <= score <= high`` of its own."""

    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __post_init__(self):
        self.lengths = lengths(self.rows)
        self.unit = units(self.rows)
        focus = min(FOCUS, self.rows.shape[1])
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :focus]


class Best:
    """The best ``keep`` rows per anchor and band met so far: higher scores, then smaller ids."""

    def __init__(self, anchors: Anchors, keep: int):
        self.anchors, self.keep = anchors, keep
        bands = anchors.low.shape[1] if anchors.low.size else 0
        self.scores = np.full((len(anchors.ids), bands, keep), _LEAST, dtype=np.int64)
        self.ids = np.zeros((len(anchors.ids), bands, keep), dtype=np.int64)

    def least(self, who: np.ndarray) -> np.ndarray:
        """Least score that could still enter some band of an anchor."""
        return np.maximum(self.anchors.low[who], self.scores[who, :, -1]).min(axis=1)

    def add(self, who: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Take in pairs of an anchor and a row with their scores, sorted by anchor."""
        for band in range(self.scores.shape[1]):
            worst = self.scores[who, band, -1]
            fits = (scores >= self.anchors.low[who, band]) & (scores <= self.anchors.high[who, band])
            fits &= (scores > worst) | ((scores == worst) & (ids < self.ids[who, band, -1]))
            a, i, s = who[fits], ids[fits], scores[fits]
            if not len(a):
                continue
            touched = np.unique(a)
            old = self.scores[touched, band] > _LEAST
            a = np.concatenate([a, np.repeat(touched, old.sum(axis=1))])
            i = np.concatenate([i, self.ids[touched, band][old]])
            s = np.concatenate([s, self.scores[touched, band][old]])
            order = np.lexsort((i, -s, a))
            a, i, s = a[order], i[order], s[order]
            nth = np.arange(len(a)) - np.searchsorted(a, a)
            kept = nth < self.keep
            self.scores[a[kept], band, nth[kept]] = s[kept]
            self.ids[a[kept], band, nth[kept]] = i[kept]


@dataclass
class Work:
    """Pairs of an anchor and a row there were, and those whose exact score was taken."""

    pairs: int = 0
    verified: int = 0


def _warm(scores: np.ndarray, anchors: Anchors, who: np.ndarray, keep: int) -> np.ndarray:
    """Score of the ``keep``-th best pair of each anchor's hardest band, or its least score."""
    bounds = []
    for band in range(anchors.low.shape[1]):
        inside = np.where(scores <= anchors.high[who, band, None], scores, _LEAST)
        at = max(0, inside.shape[1] - keep)
        cut = np.partition(inside, at, axis=1)[:, at] if inside.shape[1] >= keep else np.full(len(who), _LEAST)
        bounds.append(np.maximum(cut, anchors.low[who, band]))
    return np.min(bounds, axis=0)


def search(bucket: Bucket, best: Best, who: np.ndarray, work: Work) -> None:
    """Bring the anchors ``who`` of a block to one bucket."""
    anchors, n = best.anchors, len(bucket.ids)
    work.pairs += len(who) * n
    bound = best.least(who)
    reach = anchors.lengths[who] * bucket.longest
    # A score of at least the bound needs an angle of at most this cosine, whatever the row's length.
    cosine = np.where(bound > 0, bound / np.maximum(reach, 1e-300), -1.0)
    open_to = cosine <= 1 + SLACK
    who, cosine, bound = who[open_to], cosine[open_to], bound[open_to]
    if not len(who):
        return
    focus = anchors.focus[who]
    low, high = feasible(np.take_along_axis(anchors.unit[who], focus, axis=1), cosine[:, None])
    begin, end = np.zeros_like(focus), np.full_like(focus, n)
    for coordinate in np.unique(focus[cosine > -1]):
        at = np.nonzero(focus == coordinate)
        begin[at] = np.searchsorted(bucket.values[coordinate], low[at], side="left")
        end[at] = np.searchsorted(bucket.values[coordinate], high[at], side="right")
    width = end - begin
    shortest = np.argmin(width, axis=1)
    dense = width[np.arange(len(who)), shortest] > DENSE_SHARE * n
    met = who[dense]
    for at in range(0, len(met), ANCHORS_AT_ONCE):
        part = met[at:at + ANCHORS_AT_ONCE]
        scores = bucket.scores(anchors.rows[part])
        work.verified += scores.size
        a, r = np.nonzero(scores >= np.maximum(_warm(scores, anchors, part, best.keep + 1), best.least(part))[:, None])
        other = bucket.ids[r] != anchors.ids[part[a]]
        best.add(part[a[other]], bucket.ids[r[other]], scores[a[other], r[other]])
    for i in np.flatnonzero(~dense):
        first = shortest[i]
        rows = bucket.order[focus[i, first], begin[i, first]:end[i, first]]
        for k in range(focus.shape[1]):
            if k != first and len(rows):
                place = bucket.places[focus[i, k], rows]
                rows = rows[(place >= begin[i, k]) & (place < end[i, k])]
        rows = rows[bucket.ids[rows] != anchors.ids[who[i]]]
        if len(rows):
            work.verified += len(rows)
            scores = bucket.scores(anchors.rows[who[i]][None], rows)[0]
            best.add(np.full(len(rows), who[i]), bucket.ids[rows], scores)


def _packed(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    size = max(1, min(BUCKET_ROWS, BUCKET_BYTES // (8 * width)))

    def pack(label: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        rows = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = coordinate_order(rows.reshape(-1, width))
        return pa.RecordBatch.from_arrays(
            [pa.array([label], pa.int64()), pa.array([table["vec_id"].to_pylist()], pa.list_(pa.int64())),
             pa.array([rows.astype("<i8").tobytes()], pa.binary()), pa.array([order.astype("<i2").tobytes()], pa.binary())],
            ["label", "ids", "rows", "coordinates"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, parts, held = None, [], 0
        for batch in batches:
            labels = batch.column(0).to_numpy()
            at = 0
            while at < len(labels):
                if held and labels[at] != label:
                    yield pack(label, parts)
                    parts, held = [], 0
                label = labels[at]
                same = int(np.searchsorted(labels[at:], label, side="right"))
                take = min(same, size - held)
                parts.append(batch.slice(at, take))
                held, at = held + take, at + take
                if held == size:
                    yield pack(label, parts)
                    parts, held = [], 0
        if held:
            yield pack(label, parts)

    return run


def index(rows: DataFrame, width: int) -> DataFrame:
    """Buckets ``(label, ids, rows, coordinates)`` of ``rows(vec_id, label, x)``, each label's longest first.

    Rows are sorted by label, length and id over all tasks, so that no label and no length, however
    common, gathers in one task, and are packed as they come.
    """
    length = F.aggregate("x", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))
    size = rows.count() * width * 8
    idle = 2 * rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-size // TASK_BYTES), min(-(-size // LEAST_TASK_BYTES), idle))
    placed = rows.select("label", (-length).alias("shorter"), "vec_id", "x").repartitionByRange(
        tasks, "label", "shorter", "vec_id"
    ).sortWithinPartitions("label", "shorter", "vec_id")
    packed = placed.select("label", "vec_id", "x").mapInArrow(_packed(width), "label long, ids array<long>, rows binary, coordinates binary")
    return stored(packed, "length-buckets")


def _meet(buckets: DataFrame, anchors: Anchors, keep: int, same_label: bool) -> DataFrame:
    """``(anchor, band, vec_id, score)``: the best rows that each task finds for each band.

    ``anchor`` is the place of the anchor in its block.
    """
    width = anchors.rows.shape[1]
    sent = anchors.ids, anchors.labels, anchors.rows, anchors.low, anchors.high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Anchors(*sent)
        best = Best(mine, keep)
        for batch in batches:
            for label, ids, rows, order in zip(*(batch.column(k) for k in range(4))):
                bucket = Bucket(
                    label.as_py(), ids.values.to_numpy(), np.frombuffer(rows.as_py(), dtype="<i8").reshape(-1, width),
                    np.frombuffer(order.as_py(), dtype="<i2").reshape(width, -1),
                )
                fits = mine.labels == bucket.label
                search(bucket, best, np.flatnonzero(fits if same_label else ~fits), Work())
        a, band, nth = np.nonzero(best.scores > _LEAST)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (a, band, best.ids[a, band, nth], best.scores[a, band, nth])],
            ["anchor", "band", "vec_id", "score"],
        )

    found = buckets.mapInArrow(run, "anchor long, band long, vec_id long, score long")
    order = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mine_block(buckets: DataFrame, block: pd.DataFrame, width: int, positives: int, negatives: int) -> DataFrame:
    """The hard negatives of one block of anchor rows ``(vec_id, label, x)``."""
    ids, labels = block["vec_id"].to_numpy(), block["label"].to_numpy()
    rows = np.stack(block["x"].to_numpy()).astype(np.int64)
    wide = np.full((len(ids), 1), -_LEAST, dtype=np.int64)
    found = _meet(buckets, Anchors(ids, labels, rows, _LEAST + 0 * wide, wide), positives, True).toPandas()
    at, band, score = found["anchor"].to_numpy(), found["rank"].to_numpy() - 1, found["score"].to_numpy()
    # No band, with a least score beyond reach, where a positive is missing or nothing lies between.
    low = np.full((len(ids), positives), -_LEAST, dtype=np.int64)
    high = np.zeros((len(ids), positives), dtype=np.int64)
    high[at, band] = score // 20 * 19 + score % 20 * 19 // 20
    half = -(-score // 2)
    low[at, band] = np.where(half <= high[at, band], half, -_LEAST)
    met = _meet(buckets, Anchors(ids, labels, rows, low, high), negatives, False)
    pairs = buckets.sparkSession.createDataFrame(
        pd.DataFrame({
            "anchor": at, "band": band, "anchor_id": ids[at], "positive_id": found["vec_id"], "positive_score": score,
        }),
        "anchor long, band long, anchor_id long, positive_id long, positive_score long",
    )
    return met.join(pairs, ["anchor", "band"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


_MINED = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def hard_negatives(
    embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = ANCHOR_EVERY
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``embeddings(vec_id, embedding, label)``; rows with a NULL id, label or vector, or a NULL or
    non-finite component, take no part; empty vectors neither. Rows of one ``vec_id`` count once,
    with the least label and vector. Anchors are rows whose id is divisible by ``every``; their
    positives are the ``positives`` best other rows of their label, and each positive has the
    ``negatives`` best rows of other labels whose score lies between half and 95 % of its own.
    Ties go to the smaller id. A positive without such rows, an anchor alone with its label, and an
    empty table give no rows. Vectors of different width are not compared. Components saturate
    where a score could exceed a long. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    vector = F.col("embedding").cast("array<double>")
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    rows = stored(
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), vector.alias("embedding"))
        .filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
        .filter(sound & (F.size("embedding") > 0))
        .select("vec_id", moved.alias("label"), whole_numbers(F.col("embedding")).alias("x"))
        .groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("row")).select("vec_id", "row.*"),
        "labelled-vectors",
    )
    folder = new_folder(spark, "hard-negatives")
    spark.createDataFrame([], _MINED).write.parquet(folder)
    for row in rows.groupBy(F.size("x").alias("width")).count().orderBy("width").toLocalIterator():
        width = row["width"]
        same = rows.filter(F.size("x") == width)
        buckets = index(same, width)
        asked = same.filter(F.col("vec_id") % every == 0)
        size = max(1, BLOCK_BYTES // (8 * width))
        blocks = -(-asked.count() // size)
        part = F.pmod(F.xxhash64("vec_id"), F.lit(max(blocks, 1)))
        for block in range(blocks):
            held = asked.filter(part == block).toPandas()
            if len(held):
                mine_block(buckets, held, width, positives, negatives).write.mode("append").parquet(folder)
    return spark.read.schema(_MINED).parquet(folder)
