"""Shared-folder tables that cut lineage, and small column helpers of the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semblance.session import checkpoint_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name of its own below the shared folder in ``spark.checkpoint.dir``."""
    return f"{checkpoint_folder(spark).rstrip('/')}/semblance/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and go on from the written table.

    The plan behind it is computed once, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def id_remainder(column: str, modulus: int) -> Column:
    """``crc32`` of an id as text, modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string")) % modulus


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """True for rows that no label may be learned from; a NULL id is not held out."""
    return F.coalesce(id_remainder(column, modulus) == remainder, F.lit(False))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` is called."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sample_rows(labels: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows of a narrow table, chosen by the hash of their key.

    Every task keeps ``n`` rows at most, so the result has a proven size bound.
    """
    return labels.orderBy(F.xxhash64(key), key).limit(n)
