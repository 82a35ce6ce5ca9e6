"""Incremental harvest, expiring buffers and hash-based ingest as streams.

The stores are append-only folders with one ``batch=<id>`` part per micro-batch. A part is written
by overwriting it, so a batch repeated after a failure leaves the same rows, and no job rewrites
what it reads.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from semblance.operators.corpus import last_wins, whole_texts
from semblance.operators.features import chunk_texts
from semblance.operators.harvest import TAGGED, latest_messages, tag_urls
from semblance.operators.incremental import changed_files
from semblance.operators.vector_index import assign_cells
from semblance.sources.sinks import expiry
from semblance.settings import BUFFER_TTL_SECONDS
from semblance.sources.tables import live_buffers

URL_SCHEMA = "channel_id string, tag string, url string, msg_id long, at long"
FILE_SCHEMA = "namespace string, name string, content_hash string"
CHUNK_SCHEMA = "namespace string, name string, chunk_no int, content_hash string, text string"
INDEX_SCHEMA = "namespace string, name string, chunk_no int, embedding array<double>, cell int, residual double"


def _write_part(df: DataFrame, store: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")


def _read_parts(spark: SparkSession, store: str, schema: str) -> DataFrame:
    """All parts of a store; a store without parts is empty."""
    full = f"{schema}, batch long"
    try:
        return spark.read.schema(full).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def harvest_stream(messages: DataFrame, tags: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Collect tagged URLs from a message stream. The checkpoint takes the place of the marker.

    ``tags(channel_id, tag)`` is a table. All messages of a batch are read; batches without a
    match add nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        asked = tags.withColumn("last_message_id", F.lit(None).cast("string"))
        found = tag_urls(latest_messages(batch, asked))
        rows = found.select(*TAGGED, "url", F.col("msg_id").cast("long"), F.col("at").cast("long"))
        _write_part(rows, store, batch_id)

    return (
        messages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def harvested_urls(spark: SparkSession, store: str) -> DataFrame:
    """Every URL once with its latest batch: newer batches first, then the order inside them."""
    rows = _read_parts(spark, store, URL_SCHEMA)
    newest = rows.groupBy(*TAGGED, "url").agg(
        F.max_by(F.struct("batch", "msg_id", "at"), "batch").alias("last")
    )
    return newest.select(*TAGGED, "url", "last.*").orderBy(*TAGGED, F.desc("batch"), F.desc("msg_id"), "at")


def buffer_stream(submissions: DataFrame) -> DataFrame:
    """Submissions of a stream with their expiry. Every version is kept, without state;
    ``current_buffer`` reads the latest live one of each key, ``buffer_changes`` emits only
    versions that win."""
    return submissions.withColumn("expires_at", expiry(F.col("created_at")))


def current_buffer(rows: DataFrame, now: Column) -> DataFrame:
    """The latest version of each buffered submission that has not expired; later writes win.

    Of versions written at one time the later in arrival wins, where ``ingest_order`` tells it,
    otherwise the one with the greater text. The parts of one version stay together.
    """
    order = [F.col("created_at")]
    if "ingest_order" in rows.columns:
        order.append(F.coalesce("ingest_order", F.lit(-1)))
    if "part_no" not in rows.columns:
        order.append(F.col("raw_text"))
    ordered = live_buffers(rows, now).withColumn("_order", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)]))
    if "part_no" not in rows.columns:
        ordered = ordered.dropDuplicates(["corpus_id", "name", "_order"])
    return last_wins(ordered, ["corpus_id", "name"], "_order").drop("_order")


def buffer_changes(submissions: DataFrame, delay: str = "0 seconds", ttl_seconds: int = BUFFER_TTL_SECONDS) -> DataFrame:
    """What changes in the buffer: winning versions, and the end of those that expire.

    ``submissions(corpus_id, name, raw_text, created_at, ingest_order)`` is a stream. A key's state
    is the time and order of its last write, never its text. A write changes the buffer when it is
    later than the state, by time and then by ``ingest_order``; writes that lost, or whose hour is
    over, give no row. Once the watermark, ``delay`` behind the latest write, has passed the expiry
    of a key, its state goes and a row with ``expired`` and no text tells so.
    """
    def update(key, frames, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            micros, _ = state.get
            state.remove()
            yield pd.DataFrame({
                "corpus_id": [key[0]], "name": [key[1]], "raw_text": [None], "created_at": [pd.Timestamp(micros, unit="us")],
                "ingest_order": [None], "expired": [True],
            })
            return
        last, won = state.get if state.exists else None, None
        for frame in frames:
            for text, at, order in zip(frame["raw_text"], frame["created_at"], frame["ingest_order"]):
                rank = (at.value // 1000, -1 if pd.isna(order) else int(order))
                if last is None or rank > tuple(last):
                    last, won = rank, (text, at, order)
        if won is None:
            state.setTimeoutTimestamp(last[0] // 1000 + ttl_seconds * 1000)
            return
        if last[0] // 1000 + ttl_seconds * 1000 <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            return
        state.update(last)
        state.setTimeoutTimestamp(last[0] // 1000 + ttl_seconds * 1000)
        yield pd.DataFrame({
            "corpus_id": [key[0]], "name": [key[1]], "raw_text": [won[0]], "created_at": [won[1]],
            "ingest_order": [won[2]], "expired": [False],
        })

    out = "corpus_id string, name string, raw_text string, created_at timestamp, ingest_order long, expired boolean"
    asked = submissions.select("corpus_id", "name", "raw_text", "created_at", F.col("ingest_order").cast("long"))
    return asked.withWatermark("created_at", delay).groupBy("corpus_id", "name").applyInPandasWithState(
        update, out, "micros long, ingest_order long", "update", GroupStateTimeout.EventTimeTimeout
    )


def ingest_stream(submissions: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Chunk only new or changed submissions of a stream.

    ``submissions(corpus_id, name, raw_text, ingest_order)``; of two versions in one batch the
    later counts. The store has a manifest row per file version, also for a text without chunks,
    so batches are compared with that narrow table. A repeated batch is compared with the parts
    before it, and its chunks are written before its manifest names them.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _read_parts(spark, f"{store}/files", FILE_SCHEMA).filter(F.col("batch") < batch_id)
        manifest = _latest_files(before).select(F.col("namespace").alias("corpus_id"), "name", "content_hash")
        latest = last_wins(whole_texts(batch), ["corpus_id", "name"], "ingest_order")
        changed = changed_files(latest, manifest).persist()
        _write_part(chunk_texts(changed), f"{store}/chunks", batch_id)
        files = changed.select(F.col("corpus_id").alias("namespace"), "name", "content_hash")
        _write_part(files, f"{store}/files", batch_id)
        changed.unpersist()

    return (
        submissions.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _latest_files(files: DataFrame) -> DataFrame:
    """The latest version of each file, from the narrow manifest alone."""
    return files.groupBy("namespace", "name").agg(
        F.max_by("content_hash", "batch").alias("content_hash"), F.max("batch").alias("batch")
    )


def ingested_chunks(spark: SparkSession, store: str) -> DataFrame:
    """Current chunks: those of the latest version of each file; a blank file has none."""
    current = _latest_files(_read_parts(spark, f"{store}/files", FILE_SCHEMA))
    chunks = _read_parts(spark, f"{store}/chunks", CHUNK_SCHEMA)
    return chunks.join(current.select("namespace", "name", "batch"), ["namespace", "name", "batch"], "left_semi").drop("batch")


def index_stream(chunks: DataFrame, store: str, centres: list[list[float]], checkpoint: str) -> StreamingQuery:
    """Keep a vector index up with a stream of chunks ``(namespace, name, chunk_no, embedding)``.

    A file's chunks of one batch replace all its earlier ones, so they must come together. Files
    are named in a manifest of their own after their vectors are written; the centres stay.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        placed = assign_cells(batch.select("namespace", "name", F.col("chunk_no").cast("int"), F.col("embedding").cast("array<double>")), centres)
        placed.write.mode("overwrite").partitionBy("cell").parquet(f"{store}/vectors/batch={batch_id}")
        files = batch.select("namespace", "name", F.lit("").alias("content_hash")).distinct()
        _write_part(files, f"{store}/files", batch_id)

    return (
        chunks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def indexed_chunks(spark: SparkSession, store: str) -> DataFrame:
    """The current index: the vectors of each file's latest batch, by cell."""
    current = _latest_files(_read_parts(spark, f"{store}/files", FILE_SCHEMA))
    vectors = _read_parts(spark, f"{store}/vectors", INDEX_SCHEMA)
    return vectors.join(current.select("namespace", "name", "batch"), ["namespace", "name", "batch"], "left_semi").drop("batch")
