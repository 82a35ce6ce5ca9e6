"""Writers. Tables are folders of Parquet files; a rewrite goes to a new version folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.settings import BUFFER_TTL_SECONDS


def buffer_rows(submissions: DataFrame, buffer_id: str, created_at: Column) -> DataFrame:
    """Submissions as rows of one buffer that expires an hour after its creation. A large
    submission has several rows, told apart by ``part_no``. Their order of arrival stays, as the
    first submission of a buffer is its target."""
    part = F.col("part_no") if "part_no" in submissions.columns else F.lit(0)
    order = [c for c in ("ingest_order",) if c in submissions.columns]
    return submissions.select(
        F.lit(buffer_id).alias("corpus_id"), "name", part.cast("bigint").alias("part_no"), "raw_text", *order,
        created_at.alias("created_at"),
    ).withColumn("expires_at", expiry(F.col("created_at")))


def expiry(created_at: Column, seconds: int = BUFFER_TTL_SECONDS) -> Column:
    return created_at + F.make_dt_interval(secs=F.lit(seconds))


def save_submissions(submissions: DataFrame, path: str, buffer_id: str | None = None) -> str:
    """Append a batch under a fresh buffer id; an empty batch still gets an id."""
    buffer_id = buffer_id or str(uuid.uuid4())
    rows = buffer_rows(submissions, buffer_id, F.current_timestamp())
    rows.write.mode("append").partitionBy("corpus_id").parquet(path)
    return buffer_id


def append_history(history: DataFrame, path: str) -> None:
    """Append ``(username, urls, instance_id, created_at)`` rows."""
    history.write.mode("append").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in ``df``; others stay untouched."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition).parquet(path)
    )
