"""Workspaces and URL history: owner-checked changes and newest-first listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semblance.functions.joins import split_join

OWNED = ["instance_id", "username"]


def of_user(rows: DataFrame, username: str, instance_id: str | None = None) -> DataFrame:
    """Rows of one owner, of one workspace if given, newest first."""
    mine = rows.filter(F.col("username") == username)
    if instance_id:
        mine = mine.filter(F.col("instance_id") == instance_id)
    return mine.orderBy(F.desc("created_at"))


def newest_first(rows: DataFrame, owner: Sequence[str], tie: str) -> DataFrame:
    """The listings of all owners at once, newest first within each owner, with their ``rank``."""
    newest = Window.partitionBy(*owner).orderBy(F.desc("created_at"), tie)
    return rows.withColumn("rank", F.row_number().over(newest)).orderBy(*owner, "rank")


def look_up_history(history: DataFrame, requests: DataFrame) -> DataFrame:
    """History rows for ``requests(username, instance_id)``; a NULL workspace asks for all."""
    wanted = requests.select("username", F.col("instance_id").alias("asked"))
    joined = split_join(history, wanted, ["username"], ["created_at"])
    return joined.filter(F.col("asked").isNull() | (F.col("asked") == F.col("instance_id")))


def add_workspaces(workspaces: DataFrame, new: DataFrame) -> DataFrame:
    return workspaces.unionByName(new)


def update_urls(workspaces: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace the URL list where workspace and owner match; other updates have no effect."""
    given = updates.select(*OWNED, F.col("github_urls").alias("_urls"))
    return (
        workspaces.join(given, OWNED, "left")
        .withColumn("github_urls", F.coalesce("_urls", "github_urls"))
        .drop("_urls")
        .select(*workspaces.columns)
    )


def delete_workspaces(workspaces: DataFrame, requests: DataFrame) -> DataFrame:
    """Remove workspaces that their owner asked to delete."""
    return workspaces.join(requests.select(*OWNED), OWNED, "left_anti")
