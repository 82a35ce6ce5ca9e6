"""Session setup shared by jobs, tests and the benchmark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "semblance", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoints are removed once nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone, which results depend on, and let measured sizes choose the join.

    Adaptive execution turns a sort-merge join into a hash join only where every partition of the
    measured side stays below the threshold.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder


def local_checkpoints(spark: SparkSession) -> SparkSession:
    """Name a folder for a local session that has none: for tests, checks and benchmarks only."""
    context = spark.sparkContext
    if (
        spark.conf.get("spark.checkpoint.dir", None) is None
        and not context.getCheckpointDir()
        and context.master.split("[")[0] == "local"
    ):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="semblance-checkpoint-"))
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the stored copy."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table to the shared folder and go on from it.

    Later steps read only the columns they need. Unlike a checkpoint it stays until the folder is
    cleaned.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
