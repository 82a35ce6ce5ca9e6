"""Work only on what is new or changed. Keys are unique, so no join here has a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.functions.text import content_hash

KEY = ["corpus_id", "name"]


def new_submissions(submissions: DataFrame, cached: DataFrame) -> DataFrame:
    """Submissions without a cached feature row."""
    return submissions.join(cached.select(*KEY), KEY, "left_anti")


def valid_cache(cached: DataFrame, submissions: DataFrame) -> DataFrame:
    """Cached rows whose submission still exists."""
    return cached.join(submissions.select(*KEY), KEY, "left_semi")


def merge_cache(valid: DataFrame, fresh: DataFrame) -> DataFrame:
    """Valid cached rows and fresh ones; a fresh row replaces a cached one of the same key."""
    return valid.join(fresh.select(*KEY), KEY, "left_anti").unionByName(fresh)


def cache_status(submissions: DataFrame, cached: DataFrame) -> DataFrame:
    """How many rows are new, cached or stale."""
    status = (
        F.when(F.col("_c").isNull(), "new").when(F.col("_s").isNull(), "stale").otherwise("cached")
    )
    return (
        submissions.select(*KEY, F.lit(True).alias("_s"))
        .join(cached.select(*KEY, F.lit(True).alias("_c")), KEY, "full")
        .groupBy(status.alias("status"))
        .agg(F.count("*").alias("n"))
    )


def changed_files(submissions: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """Submissions whose content hash differs from the manifest, or all of them if forced.

    The manifest is ``(corpus_id, name, content_hash)``; a file without entry is new.
    """
    hashed = submissions.withColumn("content_hash", content_hash(F.col("raw_text")))
    if force:
        return hashed.withColumn("status", F.lit("forced"))
    known = manifest.select(*KEY, F.col("content_hash").alias("_old"))
    return (
        hashed.join(known, KEY, "left")
        .filter(~F.col("content_hash").eqNullSafe(F.col("_old")))
        .withColumn("status", F.when(F.col("_old").isNull(), "new").otherwise("changed"))
        .drop("_old")
    )


def upsert(stored: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stored rows with ``updates`` taking the place of rows with the same key."""
    return stored.join(updates.select(*keys), list(keys), "left_anti").unionByName(updates)


def upsert_features(stored: DataFrame, submissions: DataFrame, updates: DataFrame) -> DataFrame:
    """Feature upsert that ignores updates for submissions the buffer does not hold."""
    return upsert(stored, valid_cache(updates, submissions), KEY)


def replace_chunks(chunks: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Remove all chunks of changed files and add their new ones."""
    gone = changed.select(F.col("corpus_id").alias("namespace"), "name")
    return chunks.join(gone, ["namespace", "name"], "left_anti").unionByName(fresh)
