"""URL harvest: read tagged messages after the markers and merge their URLs into the cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.operators.harvest import TAGGED, latest_messages, merge_into_cache, next_marks, tag_urls
from semblance.session import cut_lineage
from semblance.sources.tables import plain_tag


def refresh_urls(
    messages: DataFrame,
    cached: DataFrame,
    marks: DataFrame,
    scraped_at: Column,
    force: bool = False,
    limit: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The new cache and markers.

    Forced, all messages are read again and a channel and tag with any URL loses its old ones.
    """
    marks = marks.withColumn("tag", plain_tag(F.col("tag")))
    asked = marks
    if force:
        asked = marks.withColumn("last_message_id", F.lit(None).cast("string"))
    # Read by the URLs and the markers.
    latest = cut_lineage(latest_messages(messages, asked, limit))
    fresh = tag_urls(latest)
    if force:
        cached = cached.join(fresh.select(*TAGGED).distinct(), TAGGED, "left_anti")
    return merge_into_cache(cached, fresh), next_marks(latest, fresh, marks, scraped_at)
