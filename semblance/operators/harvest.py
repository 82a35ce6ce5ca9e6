"""URLs from tagged channel messages and the cache they are merged into.

The cache has one row per URL, so no list of a busy channel is ever gathered in one row:
``urls(channel_id, tag, url, pos)`` and ``marks(channel_id, tag, last_message_id, last_scraped_at)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semblance.functions.joins import split_join
from semblance.functions.urls import find_urls
from semblance.sources.tables import plain_tag

TAGGED = ["channel_id", "tag"]


def messages_after(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Each requested ``(channel_id, tag)`` with the messages after its marker."""
    wanted = marks.select("channel_id", plain_tag(F.col("tag")).alias("tag"), "last_message_id")
    joined = split_join(messages, wanted, ["channel_id"], ["msg_id"])
    after = F.coalesce(F.col("last_message_id").try_cast("bigint"), F.lit(-1).cast("bigint"))
    return joined.filter(F.col("msg_id") > after).drop("last_message_id")


def latest_messages(messages: DataFrame, marks: DataFrame, limit: int | None = None) -> DataFrame:
    """The messages after the marker, per channel and tag; with a ``limit`` the newest of them.

    A limit is applied in every task before the shuffle. Older messages are left out by it for
    good once the marker moves, so it belongs to calls that want the newest only.
    """
    after = messages_after(messages, marks)
    if limit is None:
        return after
    newest = Window.partitionBy(*TAGGED).orderBy(F.desc("msg_id"))
    return after.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)


def has_tag(content: Column, tag: Column) -> Column:
    """The tag occurs anywhere in the message, whatever the case."""
    return F.contains(F.lower(content), F.lower(tag))


def tag_urls(latest: DataFrame) -> DataFrame:
    """Distinct URLs per channel and tag in the order they are first met, newest message first."""
    found = latest.filter(has_tag(F.col("content"), F.col("tag"))).select(
        *TAGGED, (-F.col("msg_id")).alias("age"), F.posexplode(find_urls(F.col("content"))).alias("at", "url")
    )
    first = found.groupBy(*TAGGED, "url").agg(F.min(F.struct("age", "at")).alias("first"))
    return first.select(*TAGGED, "url", (-F.col("first.age")).alias("msg_id"), F.col("first.at").alias("at"))


def merge_into_cache(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """New URLs first in their order, then the cached ones not among them in theirs."""
    old = cached.join(fresh.select(*TAGGED, "url"), [*TAGGED, "url"], "left_anti")
    return fresh.select(
        *TAGGED, "url", F.lit(0).alias("age"), (-F.col("msg_id")).cast("bigint").alias("p1"), F.col("at").cast("bigint").alias("p2")
    ).unionByName(
        old.select(*TAGGED, "url", F.lit(1).alias("age"), F.col("pos").cast("bigint").alias("p1"), F.lit(0).cast("bigint").alias("p2"))
    )


def upsert_marks(marks: DataFrame, updates: DataFrame) -> DataFrame:
    """Insert or replace the marker of each ``(channel_id, tag)``; tags lose their ``#``."""
    new = updates.select(
        "channel_id", plain_tag(F.col("tag")).alias("tag"),
        F.col("last_message_id").alias("n_id"), F.col("last_scraped_at").alias("n_at"),
    )
    return marks.join(new, TAGGED, "full").select(
        *TAGGED, F.coalesce("n_id", "last_message_id").alias("last_message_id"),
        F.coalesce("n_at", "last_scraped_at").alias("last_scraped_at"),
    )


def next_marks(latest: DataFrame, fresh: DataFrame, marks: DataFrame, scraped_at: Column) -> DataFrame:
    """Markers after a scrape: they move to the newest message only where URLs were found."""
    newest = latest.groupBy(*TAGGED).agg(F.max("msg_id").cast("string").alias("last_message_id"))
    moved = newest.join(fresh.select(*TAGGED).distinct(), TAGGED, "left_semi")
    return upsert_marks(marks, moved.withColumn("last_scraped_at", scraped_at))
