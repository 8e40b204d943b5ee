"""Metric tables, summaries and the audit log of a cleaning run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsignal.functions.text import result_line

STEP = "step string, description string, params map<string,string>"


def metrics_summary(expected: DataFrame, metrics: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """One row per expected key; a metric that was not recorded is NaN."""
    joined = expected.select(*keys).distinct().join(metrics.select(*keys, *columns), keys, "left")
    return joined.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in columns])


def pairing_report(summary: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each metric over the runs of a pairing, NaN left out."""
    return summary.groupBy("pairing").agg(
        F.count(F.lit(1)).alias("n_runs"), *[F.avg(F.nanvl(F.col(c), F.lit(None).cast("double"))).alias(c) for c in columns]
    )


def result_lines(scores: DataFrame) -> DataFrame:
    """One text line per row of ``tag, mean_consistency, variability``."""
    return scores.select(result_line(F.col("tag"), F.col("mean_consistency"), F.col("variability")).alias("value"))


def step(order: int, name: str, description: Column, params: dict[str, Column]) -> Column:
    """One audit entry."""
    pairs = [v for key, value in params.items() for v in (F.lit(key), value.cast("string"))]
    mapping = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")
    return F.struct(
        F.lit(order).alias("order"), F.lit(name).alias("step"), description.alias("description"), mapping.alias("params")
    )


def processing_log(entries: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """``original_file, ts, steps`` with the steps of each file in order.  ``entries``: ``original_file, entry``."""
    plain = F.transform(
        F.array_sort(F.collect_list("entry"), lambda a, b: (a["order"] - b["order"]).cast("int")),
        lambda e: F.struct(e["step"].alias("step"), e["description"].alias("description"), e["params"].alias("params")),
    )
    when = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if timestamp is None else timestamp
    return entries.groupBy("original_file").agg(plain.alias("steps")).select("original_file", when.alias("ts"), "steps")


def as_json(rows: DataFrame, keys: list[str], out: str = "value") -> DataFrame:
    """The non-key columns as one JSON text; absent values are left out of it."""
    return rows.select(*keys, F.to_json(F.struct(*[c for c in rows.columns if c not in keys])).alias(out))


def from_json(texts: DataFrame, keys: list[str], ddl: str, column: str = "value") -> DataFrame:
    """The columns back out of the JSON text; an absent key is NULL."""
    return texts.select(*keys, F.from_json(column, ddl).alias("_j")).select(*keys, "_j.*")
