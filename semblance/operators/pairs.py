"""One target per corpus against the rest of its corpus: pairs, bounds and exact scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semblance.functions.arrays import counted
from semblance.functions.joins import broadcast_if_few, narrow_join, split_join
from semblance.functions.kernels import text_ratio
from semblance.session import cut_lineage

PAIR = ["corpus_id", "target", "other"]


def default_targets(submissions: DataFrame) -> DataFrame:
    """The first submission of each corpus. Reads only the key columns."""
    return submissions.groupBy("corpus_id").agg(F.min_by("name", "ingest_order").alias("target"))


def missing_targets(requests: DataFrame, submissions: DataFrame) -> DataFrame:
    """Requested targets that cannot be scored, with the reason."""
    wanted = requests.select("corpus_id", "target")
    names = submissions.select("corpus_id", F.col("name").alias("target"))
    absent = wanted.join(names, ["corpus_id", "target"], "left_anti")
    corpora = submissions.groupBy("corpus_id").agg(F.lit(True).alias("_known"))
    reason = F.when(F.col("_known"), F.concat(F.lit("Target '"), F.col("target"), F.lit("' not found")))
    return absent.join(corpora, "corpus_id", "left").select(
        "corpus_id", "target", F.coalesce(reason, F.lit("No submissions provided")).alias("reason")
    )


def target_pairs(submissions: DataFrame, targets: DataFrame) -> DataFrame:
    """The names of all pairs to score: linear in the submissions, never all against all."""
    others = submissions.select("corpus_id", F.col("name").alias("other"))
    pairs = split_join(others, targets.select("corpus_id", "target"), ["corpus_id"], ["other"])
    return pairs.filter(F.col("other") != F.col("target")).select(*PAIR)


def rows_of_targets(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows that belong to a target, with ``name`` renamed to ``target``.

    The names are broadcast once they are counted to be few, so the wide rows are not shuffled
    just to find the targets among them.
    """
    names = broadcast_if_few(targets.select("corpus_id", F.col("target").alias("name")))
    return rows.join(names, ["corpus_id", "name"], "left_semi").withColumnRenamed("name", "target")


def with_target(rows: DataFrame, targets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each other submission beside its target: text ``columns`` as ``t_*`` and ``o_*``.

    A corpus is split by the bytes of its texts.
    """
    mine = rows_of_targets(rows.select("corpus_id", "name", *columns), targets).select(
        "corpus_id", "target", *[F.col(c).alias(f"t_{c}") for c in columns]
    )
    others = rows.select(
        "corpus_id", F.col("name").alias("other"), *[F.col(c).alias(f"o_{c}") for c in columns]
    )
    weight = sum((F.coalesce(F.octet_length(f"o_{c}"), F.lit(0)) for c in columns), F.lit(0).cast("bigint"))
    joined = split_join(others, mine, ["corpus_id"], ["other"], weight=weight)
    return joined.filter(F.col("other") != F.col("target"))


def text_scores(rows: DataFrame, targets: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Exact text ratio of each pair for ``{text column: score name}``."""
    pairs = with_target(rows, targets, list(columns))
    return pairs.select(
        *PAIR, *[text_ratio(f"t_{c}", f"o_{c}").alias(score) for c, score in columns.items()]
    )


def item_counts(rows: DataFrame, items: Column) -> DataFrame:
    """``(corpus_id, name, item, n)``: how often each item occurs in each row's array.

    One row is one submission, so its items are counted inside the row: no text is moved.
    """
    return bag_items(rows, counted(items))


def bag_items(rows: DataFrame, bag: Column) -> DataFrame:
    """``item_counts`` of items that are counted already, as ``array<struct<item, n>>``."""
    return rows.select("corpus_id", "name", F.inline(bag))


def bag_overlap(
    submissions: DataFrame, count: Callable[[DataFrame], DataFrame], targets: DataFrame
) -> DataFrame:
    """Shared item count of each pair, as a multiset, with both sizes.

    ``count`` turns submissions into ``(corpus_id, name, item, n)``. Every other row meets at most one target row per item, and a common item is split by a salt
    of the submission's name, so neither hot items nor hot corpora gather in one task.
    """
    mine = cut_lineage(
        count(rows_of_targets(submissions, targets).withColumnRenamed("target", "name")).select(
            "corpus_id", "item", F.col("n").alias("t_n")
        )
    )
    shared = (
        narrow_join(
            count(submissions).withColumnRenamed("name", "other"), mine, ["corpus_id", "item"], ["other"], how="left"
        )
        .groupBy("corpus_id", "other")
        .agg(
            F.sum("n").alias("other_size"),
            F.sum(F.least("n", F.coalesce("t_n", F.lit(0).cast("bigint")))).alias("overlap"),
        )
    )
    sizes = mine.groupBy("corpus_id").agg(F.sum("t_n").alias("target_size"))
    asked = broadcast_if_few(targets.select("corpus_id", "target")).join(sizes, "corpus_id", "left")
    pairs = split_join(
        submissions.select("corpus_id", F.col("name").alias("other")), asked, ["corpus_id"], ["other"]
    ).filter(F.col("other") != F.col("target"))
    # A submission without items has no row in ``shared``.
    zero = F.lit(0).cast("bigint")
    return pairs.join(shared, ["corpus_id", "other"], "left").select(
        *PAIR, *[F.coalesce(c, zero).alias(c) for c in ("target_size", "other_size", "overlap")]
    )


def dice(overlap: Column, size1: Column, size2: Column, both_empty: float) -> Column:
    """``2 * overlap / (size1 + size2)`` with a fixed value for two empty bags."""
    total = size1 + size2
    return F.when(total == 0, F.lit(both_empty)).otherwise(
        2.0 * overlap.cast("double") / F.nullif(total, F.lit(0)).cast("double")
    )


def bag_scores(
    submissions: DataFrame,
    count: Callable[[DataFrame], DataFrame],
    targets: DataFrame,
    score: str,
    both_empty: float,
) -> DataFrame:
    """Dice coefficient of the item multisets of each pair.

    Over characters or tokens this never lies below the exact ratio of the sequences.
    """
    pairs = bag_overlap(submissions, count, targets)
    return pairs.select(
        *PAIR,
        dice(F.col("overlap"), F.col("target_size"), F.col("other_size"), both_empty).alias(score),
    )
