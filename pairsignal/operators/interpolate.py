"""Repair of bad channels from the good ones around them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsignal.functions.chunks import CHUNK, map_chunks
from pairsignal.functions.spline import spline_weights
from pairsignal.operators.quality import per_recording, positions
from pairsignal.operators.remix import replace_channels


def mark_bad(channels: DataFrame, bad: DataFrame) -> DataFrame:
    """Channels with ``bad`` set for every listed (rec_id, ch_idx)."""
    listed = bad.select("rec_id", "ch_idx").distinct().withColumn("_b", F.lit(True))
    return channels.join(listed, ["rec_id", "ch_idx"], "left").withColumn("bad", F.coalesce("_b", F.lit(False))).drop("_b").select(
        *channels.columns
    )


def interpolation_weights(channels: DataFrame, montage: DataFrame) -> DataFrame:
    """``rec_id, out_idx, w``: one row per bad channel of a recording that has good ones left."""
    flags = per_recording(channels.select("rec_id", "ch_idx", F.col("bad").cast("int").alias("flag")), "flag")
    per_rec = positions(channels, montage).join(flags, "rec_id").filter(F.exists("flag", lambda f: f == 1) & F.exists("flag", lambda f: f == 0))

    def run(row: dict) -> dict:
        pos, flag = row["pos"].reshape(-1, 3), np.asarray(row["flag"])
        good, bad = np.flatnonzero(flag == 0), np.flatnonzero(flag == 1)
        w = np.zeros((len(bad), len(flag)))
        w[:, good] = spline_weights(pos[good], pos[bad])
        return {"rec_id": row["rec_id"], "out_idx": bad.astype(np.int32), "w": w}

    return map_chunks(per_rec, run, "rec_id string, out_idx int, w array<double>")


def interpolate_bads(samples: DataFrame, channels: DataFrame, montage: DataFrame, recordings: DataFrame, block: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Samples with the bad channels estimated from the good ones, and channels with all flags cleared."""
    repaired = replace_channels(samples, interpolation_weights(channels, montage), recordings, block)
    return repaired, channels.withColumn("bad", F.lit(False))
