"""Channel tables: renaming, duplicate guard, picks by type, equality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairsignal.functions.text import rename_skipped, renamed_channel
from pairsignal.operators.blocks import CHANNELS, attach


def rename_channels(channels: DataFrame) -> DataFrame:
    """Numbered and reference electrodes get their net names; ``skipped`` reports names left alone by a bad number."""
    ch = F.col("ch")
    return channels.withColumns({"ch": renamed_channel(ch), "skipped": rename_skipped(ch)})


def duplicate_channels(channels: DataFrame) -> DataFrame:
    return channels.groupBy("rec_id", "ch").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def require_unique_channels(channels: DataFrame) -> DataFrame:
    """The same rows; a name that occurs twice in a recording fails the job when it is read."""
    counted = channels.groupBy("rec_id", "ch").agg(
        F.count(F.lit(1)).alias("_n"), F.collect_list(F.struct(*[c for c in channels.columns if c not in ("rec_id", "ch")])).alias("_rows")
    )
    guarded = counted.withColumn(
        "_rows",
        F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate channel "), "ch", F.lit(" in "), "rec_id"))).otherwise(F.col("_rows")),
    )
    return guarded.select("rec_id", "ch", F.inline("_rows")).select(*channels.columns)


def pick_channels(samples: DataFrame, channels: DataFrame, recordings: DataFrame, kind: str = "eeg") -> DataFrame:
    """Keep only the channels of one type in wide rows, in ``ch_idx`` order."""
    picked = (
        channels.filter(F.col("type") == kind)
        .groupBy("rec_id")
        .agg(F.sort_array(F.collect_list("ch_idx")).alias("_pick"))
    )
    return attach(samples, picked, "rec_id", bound=recordings, numbers=CHANNELS).withColumn(
        "x", F.transform("_pick", lambda i: F.get("x", i))
    ).drop("_pick")


def pick_recordings(
    samples: DataFrame, channels: DataFrame, recordings: DataFrame, kind: str = "eeg"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Samples, channels and recordings with the channels of one type only, numbered anew in their order.

    A recording without such channels is left out.  ``channels`` must be small per recording, as channel tables are.
    """
    kept = channels.filter(F.col("type") == kind)
    place = F.row_number().over(Window.partitionBy("rec_id").orderBy("ch_idx")) - 1  # one row per channel of a recording
    counts = kept.groupBy("rec_id").agg(F.count(F.lit(1)).cast("int").alias("n_channels"))
    shapes = recordings.drop("n_channels").join(counts, "rec_id")
    columns = [c for c in recordings.columns if c != "n_channels"]
    return pick_channels(samples, channels, recordings, kind), kept.withColumn("ch_idx", place), shapes.select(*columns, "n_channels")


def channel_list(channels: DataFrame) -> DataFrame:
    """One ordered name list per recording."""
    return channels.groupBy("rec_id").agg(
        F.sort_array(F.collect_list(F.struct("ch_idx", "ch"))).getField("ch").alias("names")
    )


def require_equal_sfreq(dyads: DataFrame, recordings: DataFrame) -> DataFrame:
    """Dyads with their common ``sfreq``; two different rates in one dyad are an error."""
    rates = recordings.select("rec_id", "sfreq")
    a = rates.select(F.col("rec_id").alias("rec_a"), F.col("sfreq").alias("_fa"))
    b = rates.select(F.col("rec_id").alias("rec_b"), F.col("sfreq").alias("_fb"))
    return (
        dyads.join(a, "rec_a")
        .join(b, "rec_b")
        .withColumn(
            "sfreq",
            F.when(F.col("_fa") == F.col("_fb"), F.col("_fa")).otherwise(
                F.raise_error(F.concat(F.lit("sampling rates differ in "), "dyad_id")).cast("double")
            ),
        )
        .select(*dyads.columns, "sfreq")
    )
