"""Electrode positions from position files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_montage(spark: SparkSession, path: str) -> DataFrame:
    """``ch, px, py, pz`` out of lines ``name x y z``; lines of another form are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(parts.alias("p")).filter("size(p) = 4")
    return rows.select(
        F.get("p", F.lit(0)).alias("ch"), *[F.get("p", F.lit(i)).try_cast("double").alias(n) for i, n in ((1, "px"), (2, "py"), (3, "pz"))]
    ).filter("px is not null and py is not null and pz is not null")
