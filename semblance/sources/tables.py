"""Table scans keyed by corpus, buffer or channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.functions.joins import spread


def read_submissions(spark: SparkSession, path: str, corpus_id: str | None = None) -> DataFrame:
    """All submissions, or one corpus by partition pruning when written by ``corpus_id``."""
    df = spark.read.parquet(path)
    return df if corpus_id is None else df.filter(F.col("corpus_id") == corpus_id)


def buffered_submissions(spark: SparkSession, path: str, buffer_id: str) -> DataFrame:
    """The submissions of one saved buffer, parts and all, ready to be scored; the id stays text
    where it looks like a number. A buffer of few files is dealt to all cores."""
    rows = spark.read.option("mergeSchema", "false").parquet(path)
    saved = rows.filter(F.col("corpus_id") == buffer_id).withColumn("corpus_id", F.lit(buffer_id))
    return spread(saved, "name")


def features_of(features: DataFrame, corpus_id: str | None = None) -> DataFrame:
    """Rows that carry features; an unprocessed or failed submission has none."""
    df = features.filter(F.col("tokens").isNotNull())
    return df if corpus_id is None else df.filter(F.col("corpus_id") == corpus_id)


def plain_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^#+", "")


def cached_urls(cache: DataFrame, channel_id: str, tag: str) -> DataFrame:
    """Cache rows of one channel and tag; the tag may carry its ``#``."""
    return cache.filter((F.col("channel_id") == channel_id) & (F.col("tag") == tag.lstrip("#")))


def live_buffers(buffers: DataFrame, as_of: Column) -> DataFrame:
    """Buffer rows that have not expired."""
    return buffers.filter(F.col("expires_at") > as_of)
