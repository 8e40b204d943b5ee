"""Metrics over groups of pairs: subtotals, and differences between groups with a relabelling test."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The generator of the relabellings, in whole numbers.
MODULUS, FACTOR, STEP = 2**31 - 1, 48271, 69621
RELABELLINGS = 200


def metrics_rollup(metrics: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """``levels, level, n, mean, sd``: every level's total under the ones before it, and the grand total.

    ``level`` counts the levels that are given; the columns of the others are NULL.
    """
    given = F.lit(0)
    for name in levels:
        given = given + (1 - F.grouping(name))
    return metrics.rollup(*levels).agg(
        given.cast("int").alias("level"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
    )


def group_comparison(units: DataFrame, first: str, relabellings: int = RELABELLINGS, group: str = "grp", value: str = "value", unit: str = "unit") -> DataFrame:
    """``n_first, n_rest, mean_first, mean_rest, difference, p``: units of the group ``first`` against all others.

    ``unit`` is a whole number, ``value`` too (a metric in fixed steps), so all sums are exact.  Each relabelling draws a
    group for every unit, with the share that ``first`` has; ``p`` is the share of relabellings, the given one included,
    whose difference is at least as large.  A relabelling in which a group is empty is left out.  Sums are added up inside
    each task: what is shuffled does not grow with the units.  NULL groups and values are left out; without units in one of
    the groups ``difference`` and ``p`` are NULL.
    """
    known = units.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).select(
        F.col(unit).cast("bigint").alias("_u"), F.col(value).cast("bigint").alias("_v"), (F.col(group) == first).alias("_given")
    )
    sizes = known.agg(F.count(F.lit(1)).alias("_all"), F.count_if("_given").alias("_first"))  # one row
    counted = sizes.first()
    draws = known.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(relabellings))))
    mixed = F.pmod(F.col("_u"), F.lit(MODULUS)) * FACTOR + F.col("_draw").cast("bigint") * STEP
    drawn = ((mixed % MODULUS) * FACTOR) % MODULUS * F.lit(counted["_all"]) < F.lit(counted["_first"] * MODULUS)
    label = F.when(F.col("_draw") == 0, F.col("_given")).otherwise(drawn)
    sums = draws.select("_draw", "_v", label.alias("_in")).groupBy("_draw").agg(
        F.count_if("_in").alias("_n1"), F.count_if(~F.col("_in")).alias("_n0"),
        F.sum(F.when(F.col("_in"), F.col("_v"))).alias("_s1"), F.sum(F.when(~F.col("_in"), F.col("_v"))).alias("_s0"),
    )
    means = sums.withColumns({"_m1": F.try_divide("_s1", "_n1"), "_m0": F.try_divide("_s0", "_n0")}).withColumn("_d", F.col("_m1") - F.col("_m0"))
    real = F.col("_draw") == 0
    kept = lambda c: F.max(F.when(real, F.col(c)))
    told = means.agg(
        kept("_n1").alias("n_first"), kept("_n0").alias("n_rest"), kept("_m1").alias("mean_first"), kept("_m0").alias("mean_rest"),
        kept("_d").alias("difference"), F.collect_list(F.abs("_d")).alias("_all"),  # one number per relabelling
    )
    larger = F.size(F.filter("_all", lambda d: d >= F.abs(F.col("difference"))))
    share = F.when(F.col("difference").isNotNull(), F.try_divide(larger, F.size("_all")))
    return told.select("n_first", "n_rest", "mean_first", "mean_rest", "difference", share.alias("p"))
