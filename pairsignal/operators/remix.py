"""Linear re-mix of channels: each recording times its own matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsignal.functions.chunks import CHUNK, map_chunks, matrix, pack
from pairsignal.operators.blocks import HEAVY_CHUNKS, attach, block_of, channel_count


def pack_blocks(samples: DataFrame, keys: list[str], block: int = CHUNK) -> DataFrame:
    return pack(samples.withColumn("block", block_of("t", block)), keys)


def matrix_per_key(weights: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, out_idx, w`` rows as one row per key: ``outs``, flat ``ws``."""
    packed = weights.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("out_idx", "w"))).alias("_p"))
    return packed.select(
        *keys, F.col("_p.out_idx").alias("outs"), F.flatten(F.col("_p.w")).alias("ws")
    )


def _apply(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w.T`` in which a channel of weight 0 never contributes, not even a NaN."""
    used = (w != 0).any(axis=0)
    return x[:, used] @ w[:, used].T


def replace_channels(samples: DataFrame, weights: DataFrame, recordings: DataFrame, block: int = CHUNK) -> DataFrame:
    """Overwrite the listed output channels with their weighted sums; the others stay as they are."""
    per_key = matrix_per_key(weights, ["rec_id"])
    chunks = attach(pack_blocks(samples, ["rec_id"], block), per_key, "rec_id", "left", bound=recordings, numbers=channel_count(recordings) ** 2, spread="block", heavy=HEAVY_CHUNKS)

    def run(row: dict) -> dict:
        x = matrix(row)
        if row["outs"] is not None and len(row["outs"]):
            x = x.copy()
            x[:, row["outs"]] = _apply(x, row["ws"].reshape(len(row["outs"]), -1))
        return {"rec_id": row["rec_id"], "t": row["ts"], "x": x}

    return map_chunks(chunks, run, "rec_id string, t bigint, x array<double>")


def project(samples: DataFrame, weights: DataFrame, recordings: DataFrame, block: int = CHUNK) -> DataFrame:
    """New channels ``w . x`` per recording, in ``out_idx`` order."""
    chunks = attach(
        pack_blocks(samples, ["rec_id"], block), matrix_per_key(weights, ["rec_id"]), "rec_id", bound=recordings, numbers=channel_count(recordings) ** 2, spread="block", heavy=HEAVY_CHUNKS
    )

    def run(row: dict) -> dict:
        return {"rec_id": row["rec_id"], "t": row["ts"], "x": _apply(matrix(row), row["ws"].reshape(len(row["outs"]), -1))}

    return map_chunks(chunks, run, "rec_id string, t bigint, x array<double>")
