"""Synchrony of the two sides of a pair: correlation per window, lag and channel."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsignal.functions.chunks import map_chunks
from pairsignal.operators.align import sides
from pairsignal.operators.blocks import ROW_NUMBERS, attach

WINDOWS_PER_CHUNK = 64
CHUNK_SAMPLES = 4096


def window_synchrony(samples: DataFrame, dyads: DataFrame, window: int, max_lag: int = 0) -> DataFrame:
    """``dyad_id, win, lag, ch_idx, n, r``: side a at t against side b at t + lag, over the times of a window.

    ``n`` counts the times both sides have.  ``r`` is NULL where either side does not vary or ``n`` is below 2.  Channels
    beyond the narrower side are left out.  Samples travel once: a chunk has whole windows of side a and, as a halo, the
    ``max_lag`` samples of side b around them.
    """
    size = window * max(1, min(WINDOWS_PER_CHUNK, CHUNK_SAMPLES // window))
    tagged = attach(samples.select("rec_id", "t", "x"), sides(dyads).select("rec_id", "dyad_id", "side"), "rec_id", bound=dyads, numbers=2 * ROW_NUMBERS)
    reach = F.when(F.col("side") == "b", F.lit(max_lag)).otherwise(F.lit(0))
    first = F.greatest(F.floor((F.col("t") - reach) / size), F.lit(0)).cast("bigint")
    placed = tagged.withColumn("block", F.explode(F.sequence(first, F.floor((F.col("t") + reach) / size).cast("bigint"))))

    def side(name: str):
        return F.sort_array(F.collect_list(F.when(F.col("side") == name, F.struct("t", "x")))).alias(name)

    chunks = placed.groupBy("dyad_id", "block").agg(side("a"), side("b")).filter("size(a) > 0").select(
        "dyad_id", F.col("a.t").alias("ta"), F.flatten("a.x").alias("xa"), F.col("b.t").alias("tb"), F.flatten("b.x").alias("xb")
    )

    def run(row: dict) -> dict | None:
        ta, tb = row["ta"], row["tb"]
        xa, xb = row["xa"].reshape(len(ta), -1), row["xb"].reshape(len(tb), -1 if len(tb) else 0)
        c = min(xa.shape[1], xb.shape[1]) if len(tb) else xa.shape[1]
        wins = np.unique(ta // window)
        found = {"win": [], "lag": [], "n": [], "r": []}
        for lag in range(-max_lag, max_lag + 1):
            at = np.searchsorted(tb, ta + lag)
            there = at < len(tb)
            there[there] = tb[at[there]] == ta[there] + lag
            a = xa[there][:, :c]
            b = xb[at[there]][:, :c] if len(tb) else np.zeros((0, c))
            n, r = _correlations(a, b, np.searchsorted(wins, ta[there] // window), len(wins))
            found["win"].append(wins)
            found["lag"].append(np.full(len(wins), lag))
            found["n"].append(n)
            found["r"].append(r)
        whole = {k: np.concatenate(v) for k, v in found.items()}
        return {"dyad_id": row["dyad_id"], **whole} if c else None

    made = map_chunks(chunks, run, "dyad_id string, win bigint, lag int, n bigint, r array<double>")
    return made.select("dyad_id", "win", "lag", F.posexplode("r").alias("ch_idx", "r"), "n").select(
        "dyad_id", "win", "lag", "ch_idx", "n", F.nullif(F.col("r"), F.lit(float("nan"))).alias("r")
    )


def _correlations(a: np.ndarray, b: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and correlation per group and column; NaN where either does not vary."""
    n = np.bincount(group, minlength=groups)
    r = np.full((groups, a.shape[1]), np.nan)
    for g in np.flatnonzero(n > 1):
        x, y = a[group == g], b[group == g]
        varies = (x.max(axis=0) > x.min(axis=0)) & (y.max(axis=0) > y.min(axis=0))
        dx, dy = x[:, varies] - x[:, varies].mean(axis=0), y[:, varies] - y[:, varies].mean(axis=0)
        r[g, varies] = (dx * dy).sum(axis=0) / np.sqrt((dx * dx).sum(axis=0) * (dy * dy).sum(axis=0))
    return n, r


def synchrony_by_leader(windows: DataFrame, dyads: DataFrame) -> DataFrame:
    """``dyad_id, leader, n, r``: mean over windows, channels and lags by the role that is ahead; 'none' at lag 0."""
    roles = dyads.select("dyad_id", "role_a", "role_b")
    leader = F.when(F.col("lag") > 0, F.col("role_a")).when(F.col("lag") < 0, F.col("role_b")).otherwise(F.lit("none"))
    sums = windows.groupBy("dyad_id", F.signum("lag").cast("int").alias("lag")).agg(F.count("r").alias("n"), F.sum("r").alias("_r"))
    return sums.join(roles, "dyad_id").select("dyad_id", leader.alias("leader"), "n", F.try_divide("_r", "n").alias("r"))
