"""Join helpers that keep hot keys and unknown sizes safe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semblance.session import cut_lineage
from semblance.settings import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    BYTES_PER_PART,
    MIN_SALTS,
    PARTITIONS_PER_SALT,
    ROWS_PER_PART,
)


def salt_count(df: DataFrame) -> int:
    """How many ways a hot key is split: more on a cluster that shuffles into more partitions."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_SALTS, partitions // PARTITIONS_PER_SALT)


def salt_of(columns: Sequence[str], salts: int) -> Column:
    """A salt that depends on row content only, so a recomputed task gives the same value."""
    # Never NULL, so that joins need no NULL filter and exchanges of the same rows can be reused.
    return F.coalesce(F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int"), F.lit(0))


def salted_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    salts: int | None = None,
    how: str = "inner",
) -> DataFrame:
    """Equi-join many rows per key with a side that holds one short list per key.

    ``rows`` of a hot key are split ``salts`` ways by a hash of ``spread_by`` and ``per_key`` is
    copied to each part, so no task receives a whole hot key. Adaptive execution may split
    further or, after measuring ``per_key``, turn the join into a broadcast.
    """
    salts = salts or salt_count(rows)
    left = rows.withColumn("_salt", salt_of(spread_by, salts))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(copies, [*keys, "_salt"], how).drop("_salt")


def split_join(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    rows_per_part: int | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Equi-join like ``salted_join`` that splits only hot keys, each by its own size.

    The rows per key are counted from the key columns alone. A key with ``n`` rows above the limit
    gets ``n / rows_per_part`` parts, so its parts stay of one size however large it grows, and the
    other side is copied for these keys only. With a ``weight`` in bytes per row, parts are also of
    at most about ``BYTES_PER_PART``, so wide rows are split long before they are many. Hot keys are
    few by construction; should they exceed the broadcast bound, all keys are salted instead.
    """
    limit = rows_per_part or ROWS_PER_PART
    parts_of = F.ceil(F.count("*") / limit)
    if weight is not None:
        parts_of = F.greatest(parts_of, F.ceil(F.sum(F.coalesce(weight, F.lit(0))) / BYTES_PER_PART))
    sizes = rows.groupBy(*keys).agg(parts_of.cast("int").alias("_parts"))
    hot = cut_lineage(sizes.filter("_parts > 1"))
    if hot.isEmpty():
        return rows.join(per_key, list(keys), how)
    if not is_small(hot):
        return salted_join(rows, per_key, keys, spread_by, how=how)
    parts = F.coalesce("_parts", F.lit(1))
    salt = F.coalesce(F.pmod(F.xxhash64(*spread_by), parts).cast("int"), F.lit(0))
    left = rows.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", salt).drop("_parts")
    copies = (
        per_key.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    return left.join(copies, [*keys, "_salt"], how).drop("_salt")


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table has few rows and few bytes. The count stops at ``max_rows + 1``."""
    texts = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) for f in df.schema.fields if f.dataType == T.StringType()]
    lists = [F.greatest(16 * F.size(f"`{f.name}`"), F.lit(0)) for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    fixed = F.lit(16 * len(df.columns))
    size = sum([*texts, *lists], fixed)
    n, total = df.limit(max_rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= max_rows and total <= max_bytes


def broadcast_if_few(names: DataFrame) -> DataFrame:
    """Mark a table for broadcast only after measuring that it is small in rows and bytes.

    A larger table is left to a shuffle join.
    """
    return F.broadcast(names) if is_small(names) else names


def narrow_join(
    rows: DataFrame, stored: DataFrame, keys: Sequence[str], spread_by: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join many rows with a stored table of short rows, without moving the rows if it is small.

    ``stored`` is measured first; above the bounds the join shuffles with salted keys.
    """
    if is_small(stored):
        return rows.join(F.broadcast(stored), list(keys), how)
    return salted_join(rows, stored, keys, spread_by, how=how)


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that later filters read them instead of computing them again.

    The optimizer moves a filter below a plain projection and repeats the expression there. It
    cannot move it below the generator used here.
    """
    struct = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(struct)))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give expensive row-wise work enough tasks when the input has fewer splits than cores.

    A large input already has many splits and is returned as it is, without a shuffle.
    """
    width = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= width:
        return df
    return df.repartition(width, *keys)
