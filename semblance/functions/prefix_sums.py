"""Running sums of long groups without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semblance.functions.joins import broadcast_if_few
from semblance.session import cut_lineage


def running_sums(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, total: str) -> DataFrame:
    """``rows`` with ``total``, the sum of ``value`` of a group's rows up to and with this one.

    Rows are dealt to tasks by ranges of keys and order, so a group as large as the table lies in
    many tasks. The sum of each range is added up first, one short row per task and group; a row's
    total is the sum of the ranges before its own and of the rows before it in its range. Rows that
    are equal in keys and order share a total. ``rows`` should be narrow: they are stored.
    """
    keys, order = list(keys), list(order)
    placed = cut_lineage(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("_local", F.sum(value).over(inside))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = local.join(broadcast_if_few(offsets), [F.col("_range") == F.col("_at"), *same])
    return joined.select(*rows.columns, (F.col("_before") + F.col("_local")).alias(total))
