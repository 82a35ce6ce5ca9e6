"""Building submissions from archive members and merging batches of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.functions.joins import broadcast_if_few, salted_join, split_join
from semblance.functions.prefix_sums import running_sums
from semblance.functions.text import is_nonblank
from semblance.functions.urls import keeps_member, without_extension
from semblance.settings import PART_BORDER, PART_BYTES


def keep_members(members: DataFrame, patterns: Sequence[str] = (), exclude: bool = True) -> DataFrame:
    """Apply the pattern rule to ``members(archive, member_path, member_no, content)``."""
    return members.filter(keeps_member(F.col("member_path"), patterns, exclude))


def name_submissions(members: DataFrame) -> DataFrame:
    """Give each member its submission.

    With exactly one top-level item in the archive it is taken for a container and the second
    path level names the submission, otherwise the first level does. Lowest and highest top
    item are enough to see whether there is only one.
    """
    parts = F.split(F.col("member_path"), "/")
    named = members.withColumn("_top", parts[0])
    tops = (
        named.filter(F.col("_top") != "")
        .groupBy("archive")
        .agg((F.min("_top") == F.max("_top")).alias("_container"))
    )
    second = F.nullif(F.get(parts, F.lit(1)), F.lit(""))
    name = F.when(F.col("_container") & second.isNotNull(), second).otherwise(F.col("_top"))
    return (
        split_join(named, tops, ["archive"], ["archive", "member_path"], how="left")
        .withColumn("name", name)
        .drop("_top", "_container")
    )


def combine_members(
    members: DataFrame,
    keys: Sequence[str],
    order: str,
    bare_name: str | None = None,
    limit: int = PART_BYTES,
) -> DataFrame:
    """Join the non-blank members of each group under a header line per member.

    A single member whose path equals ``bare_name`` stays without header. A group above
    ``limit`` bytes comes as several rows, ``part_no`` 0, 1, ..., each of whole members and, but
    for a longer member, within the limit; joined by a blank line the parts are the whole text.
    """
    kept = members.filter(is_nonblank(F.col("content")))
    headed = F.concat(F.lit("# === "), F.col("member_path"), F.lit(" ===\n"), F.col("content"))
    size = (F.octet_length(headed) + 2).cast("bigint")
    sized = kept.groupBy(*keys).agg(F.sum(size).alias("n_bytes"))
    over = sized.filter(F.col("n_bytes") > limit)
    # Only large groups are cut. They are few and short, and their join key is split like others.
    marked = salted_join(
        kept, over.select(*keys, F.lit(True).alias("_over")), keys, ["member_path"], how="left"
    )
    # Their parts are numbered over narrow rows, as one group may hold a large share of all members.
    within = list(dict.fromkeys([order, "member_path"]))
    places = [*keys, *within]
    heavy = marked.filter("_over")
    sizes = heavy.groupBy(*places).agg(F.sum(size).alias("_size"))
    numbered = running_sums(sizes, keys, within, "_size", "_end").select(
        *[F.col(c).alias(f"_at_{c}") for c in places], F.floor((F.col("_end") - 1) / limit).alias("part_no")
    )
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in places]
    large = heavy.join(numbered, same).drop(*[f"_at_{c}" for c in places])
    small = marked.filter(F.col("_over").isNull()).withColumn("part_no", F.lit(0).cast("bigint"))
    gathered = small.unionByName(large).groupBy(*keys, "part_no").agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.col(order).alias("o"), F.col("member_path").alias("p"), F.col("content").alias("c"))
            )
        ).alias("m")
    )
    text = F.array_join(
        F.transform("m", lambda x: F.concat(F.lit("# === "), x["p"], F.lit(" ===\n"), x["c"])),
        PART_BORDER,
    )
    if bare_name is not None:
        alone = (F.size("m") == 1) & (F.col("m")[0]["p"] == F.col(bare_name))
        text = F.when(alone, F.col("m")[0]["c"]).otherwise(text)
    return gathered.select(*keys, "part_no", text.alias("raw_text"), F.size("m").cast("bigint").alias("n_members"))


def whole_texts(submissions: DataFrame) -> DataFrame:
    """Submissions with one row per ``(corpus_id, name)``: the parts of a large one are joined again.

    Every score is one of whole texts. Submissions of a single part, and tables without
    ``part_no``, pass unmoved; the names of the others are few and short. Other columns of a
    submission are those of its first part.
    """
    if "part_no" not in submissions.columns:
        return submissions
    keys = ["corpus_id", "name"]
    several = broadcast_if_few(submissions.filter("part_no > 0").select(*keys).distinct())
    single = submissions.join(several, keys, "left_anti").drop("part_no")
    others = [c for c in single.columns if c not in (*keys, "raw_text")]
    pieces = F.array_sort(F.collect_list(F.struct("part_no", "raw_text")))
    joined = submissions.join(several, keys, "left_semi").groupBy(*keys).agg(
        F.array_join(F.transform(pieces, lambda p: p["raw_text"]), PART_BORDER).alias("raw_text"),
        *[F.min_by(c, "part_no").alias(c) for c in others],
    )
    return single.unionByName(joined)


def archive_submissions(
    members: DataFrame, patterns: Sequence[str] = (), exclude: bool = True,
    limit: int = PART_BYTES,
) -> DataFrame:
    """One submission per top-level folder or file of each archive."""
    named = name_submissions(keep_members(members, patterns, exclude))
    return combine_members(named, ["archive", "name"], "member_path", "name", limit)


def archive_as_single(
    members: DataFrame, patterns: Sequence[str] = (), exclude: bool = True,
    limit: int = PART_BYTES,
) -> DataFrame:
    """One submission per archive, members in archive order, named without the extension."""
    kept = keep_members(members, patterns, exclude)
    return combine_members(kept, ["archive"], "member_no", None, limit).withColumn(
        "name", without_extension(F.col("archive"))
    )


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keep the latest row per key; ``order`` is unique within a key and never NULL. NULL is a key
    like any other.

    Only the narrow order column is aggregated, so a hot key shrinks before the shuffle and the
    wide rows are never gathered.
    """
    latest = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(order).alias("_latest"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return rows.join(latest, [*same, F.col(order) == F.col("_latest")], "left_semi")


def extract_summary(submissions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of submissions per batch; the parts of one count once."""
    first = submissions.filter("part_no = 0")
    return first.groupBy(*keys).agg(F.count("*").alias("n_submissions"))
