"""Model inputs: orientation, length alignment, stacking, scaling, labels, splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsignal.functions.chunks import is_whole, layout, map_spaces
from pairsignal.operators.align import sides
from pairsignal.operators.blocks import CHANNELS, ROW_NUMBERS, attach, attach_whole

ROLE_CODES = {"speaker": 1, "listener": 0}
SCALINGS = ("raw", "normalized")
TRAIN_FRACTION = 0.8


def to_wide(long: DataFrame, key: str = "rec_id") -> DataFrame:
    """One row per time with the channels in ``ch_idx`` order."""
    packed = long.groupBy(key, "t").agg(F.sort_array(F.collect_list(F.struct("ch_idx", "x"))).alias("_p"))
    return packed.select(key, "t", F.col("_p.x").alias("x"))


def to_long(wide: DataFrame, index: str = "ch_idx") -> DataFrame:
    return wide.select(*[c for c in wide.columns if c != "x"], F.posexplode("x").alias(index, "x"))


def flatten(wide: DataFrame) -> DataFrame:
    """One single-feature row per (time, channel), numbered time-major."""
    width = F.size("x")
    return wide.select(
        *[c for c in wide.columns if c != "x"], width.cast("bigint").alias("_c"), F.posexplode("x").alias("ch_idx", "x")
    ).select(
        *[c for c in wide.columns if c != "x"], (F.col("t") * F.col("_c") + F.col("ch_idx")).alias("row"), "ch_idx", "x"
    )


def middle_trim(samples: DataFrame, recordings: DataFrame, n: Column, key: str = "rec_id") -> DataFrame:
    """The middle ``n`` samples of each recording, counted from 0 again; a shorter recording stays whole."""
    start = F.greatest(F.floor((F.col("n_samples") - n) / 2), F.lit(0)).cast("bigint")
    window = recordings.select(key, start.alias("_start"), n.cast("bigint").alias("_n"))
    return (
        attach(samples, window, key, bound=recordings)
        .filter("t >= _start and t < _start + _n")
        .withColumn("t", F.col("t") - F.col("_start"))
        .drop("_start", "_n")
    )


def stack_wide(samples: DataFrame, dyads: DataFrame) -> DataFrame:
    """Channels of B after channels of A at equal time; the longer tail has no partner and falls away."""
    return stack_aligned(attach(samples, sides(dyads).drop("role"), "rec_id", bound=dyads, numbers=2 * ROW_NUMBERS))


def stack_aligned(aligned: DataFrame, keys: tuple[str, ...] = ("dyad_id",)) -> DataFrame:
    """As ``stack_wide`` for rows that carry their keys and ``side`` already: one scan, one shuffle."""
    both = aligned.groupBy(*keys, "t").agg(
        *[F.any_value(F.when(F.col("side") == s, F.col("x")), F.lit(True)).alias(f"x{s}") for s in "ab"]
    )
    return both.filter("xa is not null and xb is not null").select(*keys, "t", F.concat("xa", "xb").alias("x"))


def common_lengths(dyads: DataFrame, recordings: DataFrame) -> DataFrame:
    """``dyad_id, n_short, n_long`` of the two sides."""
    return (
        sides(dyads)
        .join(recordings.select("rec_id", "n_samples"), "rec_id")
        .groupBy("dyad_id")
        .agg(F.min("n_samples").alias("n_short"), F.max("n_samples").alias("n_long"))
    )


def align_lengths(long: DataFrame, dyads: DataFrame, recordings: DataFrame) -> DataFrame:
    """Long samples of both sides up to the shorter length: ``dyad_id, side, rec_id, ch, ch_idx, t, x``."""
    limits = sides(dyads).drop("role").join(common_lengths(dyads, recordings), "dyad_id")
    return (
        attach(long, limits, "rec_id", bound=dyads, numbers=2 * ROW_NUMBERS)
        .filter("t < n_short")
        .select("dyad_id", "side", "rec_id", "ch", "ch_idx", "t", "x")
    )


def stack_long(aligned: DataFrame, dyads: DataFrame, recordings: DataFrame) -> DataFrame:
    """Number the channels of a dyad through: those of B start after those of A."""
    offset = dyads.select("dyad_id", F.col("rec_a").alias("rec_id")).join(
        recordings.select("rec_id", F.col("n_channels").alias("_n_a")), "rec_id"
    ).drop("rec_id")
    return attach(aligned, offset, "dyad_id", bound=dyads).select(
        "dyad_id",
        "side",
        "ch",
        (F.col("ch_idx") + F.when(F.col("side") == "b", F.col("_n_a")).otherwise(0)).cast("int").alias("gch_idx"),
        "t",
        "x",
    )


def _scaled(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / F.when(high == low, F.lit(1.0)).otherwise(high - low)


def minmax_long(stacked: DataFrame, dyads: DataFrame, channel: str = "gch_idx") -> DataFrame:
    """Each channel of each dyad scaled to [0, 1]; a constant channel becomes 0."""
    per_channel = stacked.groupBy("dyad_id", channel).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    stats = per_channel.groupBy("dyad_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(channel), F.struct("lo", "hi")))).alias("_s")
    )
    own = F.element_at("_s", F.col(channel))
    ranged = attach(stacked, stats, "dyad_id", bound=dyads, numbers=6 * CHANNELS)
    return ranged.withColumn("x", _scaled(F.col("x"), own["lo"], own["hi"])).drop("_s")


def _with_ranges(stacked: DataFrame, keys: list[str], cells: DataFrame) -> DataFrame:
    """Add ``_s``, the (lo, hi) of each channel in order."""
    values = stacked.select(*keys, F.posexplode("x").alias("ch_idx", "v"))
    per_channel = values.groupBy(*keys, "ch_idx").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    stats = per_channel.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ch_idx", "lo", "hi"))).alias("_s"))
    return attach(stacked, stats, keys, bound=cells, numbers=6 * CHANNELS)


def minmax_wide(stacked: DataFrame, keys: list[str], cells: DataFrame) -> DataFrame:
    """As ``minmax_long`` on wide rows; ``cells`` holds at least one row per key."""
    ranged = _with_ranges(stacked, keys, cells)
    return ranged.withColumn("x", F.zip_with("x", "_s", lambda v, s: _scaled(v, s["lo"], s["hi"]))).drop("_s")


def stack_in_time(
    samples: DataFrame, pairs: DataFrame, channel_lists: DataFrame, recordings: DataFrame
) -> DataFrame:
    """Second recording after the first.  ``pairs`` is ``out_id, rec_1, rec_2``; names, order and rate must agree."""
    meta = channel_lists.join(recordings.select("rec_id", "sfreq", "n_samples"), "rec_id")
    one = meta.select(F.col("rec_id").alias("rec_1"), F.col("names").alias("n1"), F.col("sfreq").alias("f1"), F.col("n_samples").alias("len1"))
    two = meta.select(F.col("rec_id").alias("rec_2"), F.col("names").alias("n2"), F.col("sfreq").alias("f2"))
    problem = F.when(F.col("n1") != F.col("n2"), F.lit("channel names or order differ in ")).when(
        F.col("f1") != F.col("f2"), F.lit("sampling rates differ in ")
    )
    checked = pairs.join(one, "rec_1").join(two, "rec_2").withColumn(
        "len1",
        F.when(problem.isNull(), F.col("len1")).otherwise(F.raise_error(F.concat(problem, F.col("out_id"))).cast("bigint")),
    )
    plan = checked.select(
        "out_id",
        F.inline(
            F.array(
                F.struct(F.col("rec_1").alias("rec_id"), F.lit(0).cast("bigint").alias("shift")),
                F.struct(F.col("rec_2").alias("rec_id"), F.col("len1").alias("shift")),
            )
        ),
    )
    moved = attach(samples, plan, "rec_id", bound=pairs, numbers=2 * ROW_NUMBERS)
    return moved.withColumn("t", F.col("t") + F.col("shift")).drop("shift", "rec_id").withColumnRenamed("out_id", "rec_id")


def channel_roles(dyads: DataFrame, recordings: DataFrame, codes: dict[str, int] | None = None) -> DataFrame:
    """Role and integer label of each stacked channel: ``dyad_id, gch_idx, role, y``."""
    codes = ROLE_CODES if codes is None else codes
    width = recordings.select("rec_id", "n_channels")
    own = sides(dyads).join(width, "rec_id")
    first = dyads.select("dyad_id", F.col("rec_a").alias("rec_id")).join(width, "rec_id").select(
        "dyad_id", F.col("n_channels").alias("_n_a")
    )
    y = F
    for role, code in codes.items():
        y = y.when(F.col("role") == role, F.lit(code))
    start = F.when(F.col("side") == "b", F.col("_n_a")).otherwise(0)
    return (
        own.join(first, "dyad_id")
        .withColumn("gch_idx", F.explode(F.sequence(start, start + F.col("n_channels") - 1)))
        .select("dyad_id", "gch_idx", "role", y.cast("tinyint").alias("y"))
    )


def label_samples(wide: DataFrame, roles: DataFrame, dyads: DataFrame) -> DataFrame:
    """One row per (time, channel) with the label of the channel's role.

    Packed samples (``ts, xs``) with the lengths of their pairing become whole chunks with ``label``, numbered time-major.
    """
    packed = roles.groupBy("dyad_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("gch_idx", "role", "y"))), lambda s: F.struct(s["role"], s["y"])).alias("_l")
    )
    if is_whole(wide):
        labelled = attach_whole(wide, packed, "dyad_id", bound=dyads, numbers=6 * CHANNELS)
        return _label_whole(labelled.select(*wide.columns, F.col("_l.y").cast("array<double>").alias("y")))
    rows = attach(wide, packed, "dyad_id", bound=dyads, numbers=6 * CHANNELS)
    return rows.select("dyad_id", "t", F.posexplode(F.arrays_zip("x", "_l")).alias("gch_idx", "_z")).select(
        "dyad_id", "t", "gch_idx", F.col("_z.x").alias("x"), F.col("_z._l.role").alias("role"), F.col("_z._l.y").alias("y")
    )


def _label_whole(chunks: DataFrame) -> DataFrame:
    kept = [c for c in chunks.columns if c not in ("ts", "xs", "y")]

    def run(row: dict) -> dict:
        t, y = row["ts"], row["y"]
        if len(row["xs"]) != len(t) * len(y):
            raise ValueError(f"the samples of {row['pairing']} have not one value for each role")
        numbered = t[:, None] * len(y) + np.arange(len(y))
        return {**{c: row[c] for c in kept}, "ts": [numbered.ravel()], "xs": [row["xs"]], "label": [np.tile(y, len(t))]}

    return map_spaces(chunks, run, f"{layout(chunks, *kept)}, ts binary, xs binary, label binary")


def repeat_over_channels(embedded: DataFrame, roles: DataFrame, cells: DataFrame, key: str = "dyad_id") -> DataFrame:
    """Each embedding row once per channel with that channel's label: the table behind a channel-coloured view."""
    packed = roles.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("gch_idx", "role", "y"))).alias("_l"))
    return attach(embedded, packed, key, bound=cells, numbers=8 * CHANNELS).select(*embedded.columns, F.inline("_l"))


def time_split(samples: DataFrame, recordings: DataFrame, key: str = "rec_id", fraction: float = TRAIN_FRACTION) -> DataFrame:
    """Mark the first ``int(fraction * T)`` samples 'train', the rest 'test'."""
    edge = F.floor(F.lit(float(fraction)) * F.col("n_samples")).cast("bigint")
    limits = recordings.select(key, edge.alias("_edge"))
    return (
        attach(samples, limits, key, bound=recordings)
        .withColumn("split", F.when(F.col("t") < F.col("_edge"), F.lit("train")).otherwise(F.lit("test")))
        .drop("_edge")
    )


def sixths(samples: DataFrame, recordings: DataFrame, parts: tuple[int, ...] = (1, 3), key: str = "rec_id",
           fraction: float = TRAIN_FRACTION) -> DataFrame:
    """The chosen sixths of the training samples (counted from 0)."""
    sixth = F.floor(F.floor(F.lit(float(fraction)) * F.col("n_samples")) / 6).cast("bigint")
    rows = attach(samples, recordings.select(key, sixth.alias("_six")), key, bound=recordings).filter("_six > 0")
    return rows.withColumn("part", F.floor(F.col("t") / F.col("_six")).cast("int")).filter(
        F.col("part").isin(list(parts))
    ).drop("_six")


def pick_times(samples: DataFrame, times: DataFrame, key: str = "rec_id") -> DataFrame:
    """All channels of the listed times."""
    return samples.join(times.select(key, "t").distinct(), [key, "t"], "left_semi")


def skip_cells(cells: DataFrame, excluded: DataFrame) -> DataFrame:
    """Grid cells without the excluded ones."""
    return cells.join(excluded, ["clean", "scaling", "pairing"], "left_anti")


def prepare_grid(samples: DataFrame, cells: DataFrame) -> DataFrame:
    """All grid cells at once: stacked samples, raw and scaled.

    ``samples`` has ``clean, rec_id, t, x``; ``cells`` has ``clean, pairing, rec_a, rec_b``.
    Result: ``clean, scaling, pairing, t, x``.
    """
    members = cells.select(
        "clean",
        "pairing",
        F.inline(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"rec_{s}").alias("rec_id")) for s in "ab"])),
    )
    raw = stack_aligned(attach(samples, members, ["clean", "rec_id"], bound=cells, numbers=2 * ROW_NUMBERS), ("clean", "pairing"))
    ranged = _with_ranges(raw, ["clean", "pairing"], cells)
    scaled = F.zip_with("x", "_s", lambda v, s: _scaled(v, s["lo"], s["hi"]))
    both = F.array(*[F.struct(F.lit(n).alias("scaling"), v.alias("x")) for n, v in zip(SCALINGS, (F.col("x"), scaled))])
    return ranged.select("clean", "pairing", "t", F.inline(both)).select("clean", "scaling", "pairing", "t", "x")
