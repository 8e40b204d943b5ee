"""Reading and writing the engine's own tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsignal.operators.blocks import BLOCK, block_of

CELL = ["clean", "scaling", "pairing"]


def write_grid(grid: DataFrame, path: str, mode: str = "overwrite", block: int = BLOCK) -> None:
    """Prepared inputs under ``clean=/scaling=/pairing=``.

    A cell is written by as many tasks as it has time blocks, each file sorted by time.  With dynamic overwrite
    only the cells present in ``grid`` are replaced.
    """
    spread = grid.repartition(*CELL, block_of("t", block)).sortWithinPartitions(*CELL, "t")
    spread.write.mode(mode).partitionBy(*CELL).option("partitionOverwriteMode", "dynamic").parquet(path)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def shape_report(grid: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Samples and channels of each cell."""
    return grid.groupBy(*(keys or CELL)).agg(F.count(F.lit(1)).alias("n_samples"), F.max(F.size("x")).alias("n_channels"))


def discover_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells that exist under ``path``, in order."""
    return read_grid(spark, path).select(*CELL).distinct().orderBy(*CELL)


def missing_cells(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.join(found, CELL, "left_anti")


def write_samples(samples: DataFrame, path: str, mode: str = "overwrite", block: int = BLOCK) -> None:
    """Cleaned recordings; files are clustered by recording and time, so a reader of one recording skips the rest."""
    keys = [c for c in ("dyad_id", "rec_id") if c in samples.columns]
    samples.repartition(*keys, block_of("t", block)).sortWithinPartitions(*keys, "t").write.mode(mode).parquet(path)


def write_csv(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).option("header", True).csv(path)


def record_runs(rows: DataFrame, path: str, keys: Sequence[str], kind: str = "csv") -> None:
    """Metric rows under ``key=value`` folders; a rerun replaces the rows of its own keys and no others.

    Spark writes into a staging folder and moves whole partitions when all tasks have ended, so neither a lost executor nor
    a second run leaves rows twice.
    """
    writer = rows.repartition(*keys).write.mode("overwrite").partitionBy(*keys).option("partitionOverwriteMode", "dynamic")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def read_runs(spark: SparkSession, path: str, ddl: str, kind: str = "csv") -> DataFrame:
    return spark.read.schema(ddl).option("header", True).format(kind).load(path)


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("header", True).csv(path)


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Records with the columns of ``ddl``; a key that is absent is NULL."""
    return spark.read.schema(ddl).json(path)


def write_lines(lines: DataFrame, path: str, mode: str = "append") -> None:
    lines.select("value").write.mode(mode).text(path)
