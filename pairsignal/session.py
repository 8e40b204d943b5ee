"""Session settings the package is written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "pairsignal", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution on; on a cluster the submit settings stay in charge."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a scratch folder only in local mode when none is named."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    context.setCheckpointDir(folder)
    return folder


def settle(table: DataFrame) -> DataFrame:
    """Write an intermediate table to the checkpoint folder and go on from there.

    For results that several later steps read and that are far smaller than the samples they came from: the
    lineage ends here, nothing is computed twice, and a lost executor costs no more than reading again.
    """
    spark = table.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/settled-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
