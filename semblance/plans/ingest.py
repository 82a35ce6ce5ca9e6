"""Corpus building: members and articles become submissions of a buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.operators.corpus import (
    combine_members,
    keep_members,
    last_wins,
    name_submissions,
    whole_texts,
)
from semblance.functions.urls import without_extension
from semblance.operators.features import chunk_texts
from semblance.operators.incremental import changed_files, replace_chunks
from semblance.operators.vectors import chunk_manifest
from semblance.settings import DEFAULT_IGNORE_PATTERNS, OS_JUNK_PATTERNS
from semblance.sources.files import member_text, page_articles
from semblance.sources.sinks import save_submissions

IGNORED = (*OS_JUNK_PATTERNS, *DEFAULT_IGNORE_PATTERNS)


def decode_members(members: DataFrame) -> DataFrame:
    """``content`` as text from ``members(..., member_path, content BINARY)``."""
    return members.withColumn("content", member_text(F.col("member_path"), F.col("content")))


def extract_archives(
    members: DataFrame, patterns: Sequence[str] = IGNORED, exclude: bool = True, single: bool = False
) -> DataFrame:
    """Submissions ``(name, part_no, raw_text)`` of a batch of archives.

    ``members(archive, ingest_order, member_path, member_no, content)``; ``ingest_order`` is the
    arrival of the archive. Of archives with one submission name the later wins; this is settled
    among the names before any text is gathered.
    """
    kept = keep_members(members, patterns, exclude)
    if single:
        named = kept.withColumn("name", without_extension(F.col("archive")))
        order, bare = "member_no", None
    else:
        named, order, bare = name_submissions(kept), "member_path", "name"
    keys = ["name", "archive", "ingest_order"]
    return combine_members(last_archive(named), keys, order, bare).select("name", "part_no", "raw_text")


def last_archive(named: DataFrame) -> DataFrame:
    """The members of the latest archive of each submission name."""
    latest = named.groupBy(F.col("name").alias("_name")).agg(F.max("ingest_order").alias("_latest"))
    return named.join(
        latest, F.col("name").eqNullSafe(F.col("_name")) & (F.col("ingest_order") == F.col("_latest")), "left_semi"
    )


def extract_pages(pages: DataFrame, order: str) -> DataFrame:
    """Article submissions; of two versions of one address the later wins. The name is a label
    that several articles may share."""
    return last_wins(page_articles(pages), ["url"], order).select("url", "name", "raw_text")


def build_corpus(
    spool: str, archives: DataFrame | None = None, files: DataFrame | None = None, pages: DataFrame | None = None,
    patterns: Sequence[str] = IGNORED, exclude: bool = True,
) -> str:
    """Members, bare files and pages become one saved buffer; returns its id.

    ``archives(archive, ingest_order, member_path, member_no, content BINARY)``,
    ``files(name, ingest_order, content BINARY)`` and ``pages(url, html, ingest_order)`` are
    decoded, filtered and merged; of equal names the later arrival wins, and an archive's
    submissions arrive with it.
    """
    parts = []
    if archives is not None:
        kept = keep_members(decode_members(archives), patterns, exclude)
        built = combine_members(last_archive(name_submissions(kept)), ["name", "archive", "ingest_order"], "member_path", "name")
        parts.append(built.select("name", "part_no", "raw_text", "ingest_order"))
    zero = F.lit(0).cast("bigint").alias("part_no")
    if files is not None:
        renamed = decode_members(files.withColumn("member_path", F.col("name")))
        parts.append(keep_members(renamed, patterns, exclude).select("name", zero, F.col("content").alias("raw_text"), "ingest_order"))
    if pages is not None:
        articles = last_wins(page_articles(pages), ["url"], "ingest_order")
        # Articles of one name from several addresses stay apart by their address.
        parts.append(articles.select(F.concat_ws(" ", "name", "url").alias("name"), zero, "raw_text", "ingest_order"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    latest = last_archive(merged)
    return save_submissions(latest.withColumn("corpus_id", F.lit("buffer")), spool)


def ingest_batch(submissions: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunk table after a batch: changed files lose their old chunks and get new ones."""
    manifest = chunk_manifest(chunks).select(F.col("namespace").alias("corpus_id"), "name", "content_hash")
    changed = changed_files(whole_texts(submissions), manifest)
    return replace_chunks(chunks, changed, chunk_texts(changed))
