"""Bad-channel criteria over whole recordings.

All criteria read wide samples.  Channel statistics are exact: an approximate quantile sketch brackets each
rank, and only the few values inside the bracket are counted out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsignal.functions.chunks import map_chunks, matrix, pack
from pairsignal.functions.spline import spline_weights
from pairsignal.operators.blocks import attach, channel_count, largest
from pairsignal.operators.filters import band, fir
from pairsignal.session import settle

# Thresholds of the criteria.
FLAT = 1e-15
IQR_TO_SD = 0.7413
MAD_TO_SD = 1.4826
Z_LIMIT = 5.0
HF_CUTOFF = 50.0
CORR_SECONDS = 1.0
CORR_QUANTILE = 0.98
CORR_LIMIT = 0.4
CORR_FRACTION = 0.01
RANSAC_SECONDS = 5.0
RANSAC_SAMPLES = 50
RANSAC_PART = 0.25
RANSAC_CORR = 0.75
RANSAC_FRACTION = 0.4
RANSAC_SEED = 1337

ACCURACY = 10_000
DIRECT_SAMPLES = 100_000  # recordings up to this length are sorted per channel in one aggregation
WINDOWS_PER_CHUNK = 16


def per_recording(stats: DataFrame, *columns: str) -> DataFrame:
    """One row per recording with an array per column, in channel order."""
    packed = stats.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("ch_idx", *columns))).alias("_p"))
    return packed.select("rec_id", *[F.col(f"_p.{c}").alias(c) for c in columns])


def channel_quantiles(samples: DataFrame, recordings: DataFrame, qs: Sequence[float], accuracy: int = ACCURACY,
                      direct: int = DIRECT_SAMPLES) -> DataFrame:
    """Exact, linearly interpolated quantiles per channel without NaN: ``rec_id, ch_idx, n, q array<double>``.

    Short recordings need one aggregation over bounded groups; if any is longer than ``direct`` samples, all go
    through rank brackets, which never gather a channel in one place.
    """
    if (largest(recordings, "n_samples") or 0) <= direct:
        values = samples.select("rec_id", F.posexplode("x").alias("ch_idx", "v")).filter(~F.isnan("v"))
        return values.groupBy("rec_id", "ch_idx").agg(
            F.count(F.lit(1)).alias("n"), F.percentile("v", F.array(*[F.lit(float(q)) for q in qs])).alias("q")
        )
    return _bracketed_quantiles(samples, recordings, qs, accuracy)


def _bracketed_quantiles(samples: DataFrame, recordings: DataFrame, qs: Sequence[float], accuracy: int) -> DataFrame:
    margin = 2.0 / accuracy
    marks = [min(max(q + s * margin, 0.0), 1.0) for q in qs for s in (-1, 1)]
    values = samples.select("rec_id", F.posexplode("x").alias("ch_idx", "v"))
    usable = F.when(~F.isnan("v"), F.col("v"))
    sketch = values.groupBy("rec_id", "ch_idx").agg(F.percentile_approx(usable, marks, accuracy).alias("m"))
    rows = attach(samples, settle(per_recording(sketch, "m")), "rec_id", bound=recordings, numbers=3 * len(qs) * channel_count(recordings))
    paired = rows.select("rec_id", F.posexplode(F.zip_with("x", "m", lambda v, m: F.struct(v.alias("v"), m.alias("m")))).alias("ch_idx", "_z"))
    v = F.col("_z.v")

    def place(i: int) -> Column:
        zone = F.when(v < F.get("_z.m", F.lit(2 * i)), 0).when(v <= F.get("_z.m", F.lit(2 * i + 1)), 1).otherwise(2)
        return F.struct(F.lit(i).alias("qi"), zone.alias("zone"))

    placed = paired.filter(~F.isnan(v)).select(
        "rec_id", "ch_idx", v.alias("v"), F.inline(F.array(*[place(i) for i in range(len(qs))]))
    )
    counted = placed.groupBy("rec_id", "ch_idx", "qi", "zone", F.when(F.col("zone") == 1, F.col("v")).alias("key")).agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    of_rank = Window.partitionBy("rec_id", "ch_idx", "qi")
    ranked = counted.withColumns(
        {
            "n": F.sum("c").over(of_rank),
            "last": F.sum("c").over(of_rank.orderBy("zone", "key").rowsBetween(Window.unboundedPreceding, 0)) - 1,
        }
    )
    first = F.col("last") - F.col("c") + 1
    position = F.get(F.array(*[F.lit(float(q)) for q in qs]), F.col("qi")) * (F.col("n") - 1)

    def at(rank: Column) -> Column:
        value = (
            F.when(F.col("zone") == 1, F.col("key"))
            .when((F.col("zone") == 0) & (rank == F.col("last")), F.col("most"))
            .when((F.col("zone") == 2) & (rank == first), F.col("least"))
            .otherwise(F.raise_error(F.lit("quantile bracket missed its rank: raise accuracy")).cast("double"))
        )
        return F.max(F.when((rank >= first) & (rank <= F.col("last")), value))

    ends = ranked.withColumn("pos", position).groupBy("rec_id", "ch_idx", "qi").agg(
        F.max("n").alias("n"), F.max("pos").alias("pos"),
        at(F.floor("pos")).alias("low"), at(F.ceil("pos")).alias("high"),
    )
    share = F.col("pos") - F.floor("pos")
    return ends.withColumn("value", F.col("low") + (F.col("high") - F.col("low")) * share).groupBy("rec_id", "ch_idx").agg(
        F.max("n").alias("n"),
        F.sort_array(F.collect_list(F.struct("qi", "value"))).getField("value").alias("q"),
    )


def channel_mad(samples: DataFrame, recordings: DataFrame) -> DataFrame:
    """Median absolute deviation per channel: ``rec_id, ch_idx, mad``; a channel of NaN only has none."""
    middle = channel_quantiles(samples, recordings, [0.5]).select("ch_idx", "rec_id", F.get("q", F.lit(0)).alias("med"))
    by_channel = middle.groupBy("rec_id").agg(F.map_from_entries(F.collect_list(F.struct("ch_idx", "med"))).alias("_m"))
    if (largest(recordings, "n_samples") or 0) > DIRECT_SAMPLES:
        by_channel = settle(by_channel)
    in_order = by_channel.select("rec_id", F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys("_m"))), lambda i: F.try_element_at("_m", i)).alias("med"))
    rows = attach(samples, in_order, "rec_id", bound=recordings, numbers=2 * channel_count(recordings))
    spread = rows.select(
        "rec_id", "t", F.transform("x", lambda v, i: F.abs(v - F.coalesce(F.get("med", i), F.lit(float("nan"))))).alias("x")
    )
    return channel_quantiles(spread, recordings, [0.5]).select("rec_id", "ch_idx", F.get("q", F.lit(0)).alias("mad"))


def robust_z(stats: DataFrame, value: str) -> DataFrame:
    """Add ``z``: distance of each channel's value from the channels' median in robust standard deviations."""
    # One recording has a bounded number of channels, so this window is small.
    across = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(Window.partitionBy("rec_id"))
    q = [F.get("_q", F.lit(i)) for i in range(3)]
    z = F.try_divide(F.col(value) - q[1], F.lit(IQR_TO_SD) * (q[2] - q[0]))
    return stats.withColumn("_q", across).withColumn("z", z).drop("_q")


def _listed(df: DataFrame, criterion: str) -> DataFrame:
    return df.select("rec_id", "ch_idx", F.lit(criterion).alias("criterion"))


def bad_by_nan(samples: DataFrame) -> DataFrame:
    values = samples.select("rec_id", F.posexplode("x").alias("ch_idx", "v"))
    return _listed(values.groupBy("rec_id", "ch_idx").agg(F.max(F.isnan("v")).alias("bad")).filter("bad"), "nan")


def flatness(samples: DataFrame, recordings: DataFrame) -> DataFrame:
    """``rec_id, ch_idx, sd, mad`` without NaN values."""
    values = samples.select("rec_id", F.posexplode("x").alias("ch_idx", "v")).filter(~F.isnan("v"))
    sd = values.groupBy("rec_id", "ch_idx").agg(F.stddev_pop("v").alias("sd"))
    return sd.join(channel_mad(samples, recordings), ["rec_id", "ch_idx"])


def bad_by_flat(samples: DataFrame, recordings: DataFrame, limit: float = FLAT) -> DataFrame:
    return _listed(flatness(samples, recordings).filter((F.col("sd") < limit) | (F.col("mad") < limit)), "flat")


def mask_channels(samples: DataFrame, bad: DataFrame, recordings: DataFrame) -> DataFrame:
    """Samples whose listed channels are NaN throughout, so that later criteria leave them out."""
    listed = bad.groupBy("rec_id").agg(F.collect_set("ch_idx").alias("_bad"))
    rows = attach(samples, listed, "rec_id", how="left", bound=recordings, numbers=channel_count(recordings))
    hidden = F.transform(
        "x", lambda v, i: F.when(F.array_contains(F.coalesce("_bad", F.array().cast("array<int>")), i), F.lit(float("nan"))).otherwise(v)
    )
    return rows.select("rec_id", "t", hidden.alias("x"))


def deviation(samples: DataFrame, recordings: DataFrame, spread: tuple[float, float] = (0.25, 0.75)) -> DataFrame:
    """``rec_id, ch_idx, amp, z``: robust amplitude of each channel against the others."""
    q = channel_quantiles(samples, recordings, list(spread))
    amp = q.select("rec_id", "ch_idx", (F.lit(IQR_TO_SD) * (F.get("q", F.lit(1)) - F.get("q", F.lit(0)))).alias("amp"))
    return robust_z(amp, "amp")


def bad_by_deviation(samples: DataFrame, recordings: DataFrame, limit: float = Z_LIMIT) -> DataFrame:
    return _listed(deviation(samples, recordings).filter(F.abs("z") > limit), "deviation")


def hf_noise(samples: DataFrame, recordings: DataFrame, taps: list[float] | None = None, cutoff: float = HF_CUTOFF) -> DataFrame:
    """``rec_id, ch_idx, noise, z``: spread of the part above ``cutoff`` over the spread of the part below."""
    if taps is None:
        both = band(samples, recordings, None, cutoff, residual=True)
    else:
        both = fir(samples, recordings, taps, residual=True)
    # Channels 0..C-1 are the smooth part, C..2C-1 what it leaves over.
    spreads = attach(channel_mad(both, recordings), recordings.select("rec_id", "n_channels"), "rec_id", bound=recordings, spread="ch_idx")
    ratio = spreads.groupBy("rec_id", (F.col("ch_idx") % F.col("n_channels")).alias("ch_idx")).agg(
        F.try_divide(
            F.max(F.when(F.col("ch_idx") >= F.col("n_channels"), F.col("mad"))),
            F.max(F.when(F.col("ch_idx") < F.col("n_channels"), F.col("mad"))),
        ).alias("noise")
    )
    return robust_z(ratio, "noise")


def bad_by_hf_noise(samples: DataFrame, recordings: DataFrame, taps: list[float] | None = None, limit: float = Z_LIMIT,
                    cutoff: float = HF_CUTOFF) -> DataFrame:
    """Channels with much more high-frequency content than the others; rates too low to tell give none."""
    fast = recordings if taps is not None else recordings.filter(F.col("sfreq") > 2 * cutoff)
    chosen = samples if taps is not None else attach(samples, fast.select("rec_id"), "rec_id", bound=recordings)
    return _listed(hf_noise(chosen, fast, taps, cutoff).filter(F.col("z") > limit), "hf_noise")


def _window_chunks(samples: DataFrame, recordings: DataFrame, seconds: float) -> DataFrame:
    """Chunks of whole windows with ``w`` samples each; an incomplete last window is left out."""
    w = F.floor(F.lit(seconds) * F.col("sfreq")).cast("bigint")
    meta = recordings.select("rec_id", w.alias("w"), "n_samples").filter("w >= 2")
    rows = attach(samples, meta, "rec_id", bound=recordings).filter(F.col("t") < F.floor(F.col("n_samples") / F.col("w")) * F.col("w"))
    block = F.floor(F.col("t") / (F.col("w") * WINDOWS_PER_CHUNK)).cast("bigint")
    chunks = pack(rows.withColumn("block", block).select("rec_id", "block", "t", "x"), ["rec_id"])
    return attach(chunks, meta.drop("n_samples"), "rec_id", bound=recordings, spread="block")


def _correlations(x: np.ndarray) -> np.ndarray:
    """Absolute correlation matrix; a constant channel correlates with nothing."""
    centred = x - x.mean(axis=0)
    length = np.sqrt((centred**2).sum(axis=0))
    safe = np.where(length > 0, length, 1.0)
    scaled = centred / safe * (length > 0)
    return np.abs(scaled.T @ scaled)


def window_correlations(samples: DataFrame, recordings: DataFrame, seconds: float = CORR_SECONDS,
                        quantile: float = CORR_QUANTILE) -> DataFrame:
    """``rec_id, win, ch_idx, corr``: high quantile of each channel's absolute correlation with the others."""

    def run(row: dict) -> dict:
        x, w = matrix(row), int(row["w"])
        good = np.flatnonzero(~np.isnan(x).any(axis=0))
        found = np.full((len(x) // w, x.shape[1]), np.nan)
        if len(good) > 1:
            for k in range(len(found)):
                c = _correlations(x[k * w : (k + 1) * w, good])
                others = c[~np.eye(len(good), dtype=bool)].reshape(len(good), -1)
                found[k, good] = np.quantile(others, quantile, axis=1)
        return {"rec_id": row["rec_id"], "win": row["ts"][::w] // w, "corr": found}

    per_window = map_chunks(_window_chunks(samples, recordings, seconds), run, "rec_id string, win bigint, corr array<double>")
    return per_window.select("rec_id", "win", F.posexplode("corr").alias("ch_idx", "corr")).filter(~F.isnan("corr"))


def low_fraction(windows: DataFrame, limit: float) -> DataFrame:
    """``rec_id, ch_idx, fraction`` of windows below ``limit``."""
    return windows.groupBy("rec_id", "ch_idx").agg(F.avg((F.col("corr") < limit).cast("double")).alias("fraction"))


def bad_by_correlation(samples: DataFrame, recordings: DataFrame, seconds: float = CORR_SECONDS, limit: float = CORR_LIMIT,
                       fraction: float = CORR_FRACTION) -> DataFrame:
    windows = window_correlations(samples, recordings, seconds)
    return _listed(low_fraction(windows, limit).filter(F.col("fraction") > fraction), "correlation")


def positions(channels: DataFrame, montage: DataFrame) -> DataFrame:
    """One row per recording: flat electrode positions in channel order; an unknown electrode is an error."""
    placed = channels.select("rec_id", "ch_idx", "ch").join(montage, "ch", "left")
    known = F.when(F.col("px").isNull(), F.raise_error(F.concat(F.lit("no position for "), "ch")).cast("array<double>")).otherwise(
        F.array("px", "py", "pz")
    )
    return per_recording(placed.withColumn("pos", known), "pos").select("rec_id", F.flatten("pos").alias("pos"))


def ransac_correlations(samples: DataFrame, channels: DataFrame, montage: DataFrame, recordings: DataFrame,
                        seconds: float = RANSAC_SECONDS, seed: int = RANSAC_SEED) -> DataFrame:
    """``rec_id, win, ch_idx, corr`` of each channel with its prediction from random subsets of the others."""
    chunks = attach(
        _window_chunks(samples, recordings, seconds), positions(channels, montage), "rec_id", bound=recordings,
        numbers=3 * channel_count(recordings), spread="block",
    )
    known: dict[tuple, list] = {}

    def predictors(pos: np.ndarray, good: np.ndarray) -> list:
        key = (pos.tobytes(), good.tobytes())
        if key not in known:
            known.clear()
            rng = np.random.RandomState(seed)
            size = int(np.ceil(RANSAC_PART * len(good)))
            picks = [np.sort(rng.permutation(good)[:size]) for _ in range(RANSAC_SAMPLES)]
            known[key] = [(p, spline_weights(pos[p], pos[good])) for p in picks]
        return known[key]

    def run(row: dict) -> dict:
        x, w = matrix(row), int(row["w"])
        pos = row["pos"].reshape(-1, 3)
        good = np.flatnonzero(~np.isnan(x).any(axis=0))
        found = np.full((len(x) // w, x.shape[1]), np.nan)
        if len(good) > 3:
            for k in range(len(found)):
                part = x[k * w : (k + 1) * w]
                guess = np.median([part[:, p] @ m.T for p, m in predictors(pos, good)], axis=0)
                a, b = part[:, good] - part[:, good].mean(axis=0), guess - guess.mean(axis=0)
                scale = np.sqrt((a**2).sum(axis=0) * (b**2).sum(axis=0))
                found[k, good] = np.where(scale > 0, (a * b).sum(axis=0) / np.where(scale > 0, scale, 1.0), 0.0)
        return {"rec_id": row["rec_id"], "win": row["ts"][::w] // w, "corr": found}

    per_window = map_chunks(chunks, run, "rec_id string, win bigint, corr array<double>")
    return per_window.select("rec_id", "win", F.posexplode("corr").alias("ch_idx", "corr")).filter(~F.isnan("corr"))


def bad_by_ransac(samples: DataFrame, channels: DataFrame, montage: DataFrame, recordings: DataFrame,
                  seconds: float = RANSAC_SECONDS, limit: float = RANSAC_CORR, fraction: float = RANSAC_FRACTION) -> DataFrame:
    windows = ransac_correlations(samples, channels, montage, recordings, seconds)
    return _listed(low_fraction(windows, limit).filter(F.col("fraction") > fraction), "ransac")


def find_all_bads(samples: DataFrame, channels: DataFrame, montage: DataFrame, recordings: DataFrame,
                  hf_taps: list[float] | None = None, corr_seconds: float = CORR_SECONDS,
                  ransac_seconds: float = RANSAC_SECONDS) -> DataFrame:
    """All criteria: ``rec_id, ch_idx, criterion``.  Channels bad by NaN or flatness are left out of the others."""
    unusable = settle(bad_by_nan(samples).unionByName(bad_by_flat(samples, recordings)))
    rest = mask_channels(samples, unusable, recordings)
    return (
        unusable.unionByName(bad_by_deviation(rest, recordings))
        .unionByName(bad_by_hf_noise(rest, recordings, hf_taps))
        .unionByName(bad_by_correlation(rest, recordings, corr_seconds))
        .unionByName(bad_by_ransac(rest, channels, montage, recordings, ransac_seconds))
    )


def bad_summary(bad: DataFrame) -> DataFrame:
    """Distinct bad channels of each recording: ``rec_id, n_bad, channels``."""
    distinct = bad.select("rec_id", "ch_idx").distinct()
    return distinct.groupBy("rec_id").agg(
        F.count(F.lit(1)).alias("n_bad"), F.sort_array(F.collect_list("ch_idx")).alias("channels")
    )
