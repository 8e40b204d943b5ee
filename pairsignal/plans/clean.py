"""Cleaning of recordings: rename, filter, find bad channels, repair, remove components, log."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsignal.operators import align, decompose, filters, interpolate, quality, report
from pairsignal.operators.channels import pick_recordings, rename_channels, require_unique_channels
from pairsignal.session import settle


class Cleaned(NamedTuple):
    samples: DataFrame
    channels: DataFrame
    bad: DataFrame
    components: DataFrame
    log: DataFrame


def clean(
    samples: DataFrame,
    recordings: DataFrame,
    channels: DataFrame,
    montage: DataFrame,
    excluded: DataFrame | None = None,
    l_freq: float = filters.HIGHPASS_HZ,
    taps: list[float] | None = None,
    hf_taps: list[float] | None = None,
    corr_seconds: float = quality.CORR_SECONDS,
    ransac_seconds: float = quality.RANSAC_SECONDS,
    n_components: int = decompose.COMPONENTS,
    max_rounds: int = decompose.MAX_ROUNDS,
) -> Cleaned:
    """Clean every recording in the same jobs.

    Where ``channels`` has a ``type``, only those of type 'eeg' are cleaned, numbered anew; trigger channels are left out.
    ``recordings`` has ``rec_id, sfreq, n_samples, n_channels``; ``excluded`` lists the components to remove per
    recording (``rec_id, comps``), as a person chose them.  ``taps`` replaces the designed high-pass.
    """
    if "type" in channels.columns:
        samples, channels, recordings = pick_recordings(samples, channels, recordings)
        channels, recordings = settle(channels), settle(recordings)
    named = require_unique_channels(rename_channels(channels).drop("skipped"))
    filtered = filters.band(samples, recordings, l_freq) if taps is None else filters.fir(samples, recordings, taps)
    # The filtered samples feed every criterion and the repair: written once instead of filtered again each time.
    filtered = settle(filtered)
    bad = settle(quality.find_all_bads(filtered, named, montage, recordings, hf_taps, corr_seconds, ransac_seconds))
    repaired, reset = interpolate.interpolate_bads(filtered, settle(interpolate.mark_bad(named, bad)), montage, recordings)
    repaired = settle(repaired)
    state = decompose.fit_components(repaired, recordings, n_components, max_rounds=max_rounds)
    chosen = recordings.select("rec_id", F.array().cast("array<bigint>").alias("comps")) if excluded is None else excluded
    result = decompose.remove_components(repaired, state, chosen, recordings)
    return Cleaned(result, reset, bad, state, cleaning_log(recordings, bad, chosen, state, l_freq, n_components))


def cleaning_log(recordings: DataFrame, bad: DataFrame, excluded: DataFrame, state: DataFrame, l_freq: float, n_components: int) -> DataFrame:
    """One audit record per recording."""
    per_criterion = bad.groupBy("rec_id", "criterion").agg(F.array_join(F.sort_array(F.collect_set("ch_idx")).cast("array<string>"), ",").alias("chs"))
    found = per_criterion.groupBy("rec_id").agg(F.map_from_entries(F.collect_list(F.struct("criterion", "chs"))).alias("found"))
    rows = (
        recordings.join(found, "rec_id", "left")
        .join(quality.bad_summary(bad), "rec_id", "left")
        .join(excluded, "rec_id", "left")
        .join(state.select("rec_id", "done"), "rec_id", "left")
    )
    count = F.coalesce("n_bad", F.lit(0).cast("bigint"))
    nothing = F.create_map().cast("map<string,string>")
    bad_step = F.struct(
        F.lit(3).alias("order"), F.lit("bad_channel_detection").alias("step"), F.lit("Identified bad channels").alias("description"),
        F.map_concat(F.coalesce("found", nothing), F.create_map(F.lit("n_bad_channels"), count.cast("string"))).alias("params"),
    )
    comps = F.coalesce(F.array_join(F.col("comps").cast("array<string>"), ","), F.lit(""))
    steps = F.array(
        report.step(1, "load_data", F.lit("Loaded recording"), {"n_channels": F.col("n_channels"), "duration_seconds": (F.col("n_samples") - 1) / F.col("sfreq")}),
        report.step(2, "highpass_filter", F.format_string("Applied %.1f Hz high-pass filter", F.lit(float(l_freq))), {"l_freq": F.lit(l_freq)}),
        bad_step,
        report.step(4, "interpolate_bads", F.lit("Interpolated bad channels"), {"n_interpolated": count}),
        report.step(5, "ica_fit", F.lit("Fitted components"), {"n_components": F.lit(n_components), "random_state": F.lit(decompose.SEED), "converged": F.coalesce("done", F.lit(False))}),
        report.step(6, "ica_apply", F.lit("Removed chosen components"), {"excluded_components": comps}),
    )
    return report.processing_log(rows.select(F.col("rec_id").alias("original_file"), F.explode(steps).alias("entry")))


def clean_pairs(samples: DataFrame, recordings: DataFrame, dyads: DataFrame, channels: DataFrame, montage: DataFrame,
                annotations: DataFrame | None = None, **options) -> tuple[Cleaned, DataFrame]:
    """Mutual alignment of every dyad, then cleaning of both sides; also returns the segments.

    A recording of several dyads is cut differently in each, so the cleaned recordings are named ``dyad/side``.
    """
    aligned = align.mutually_align(samples, recordings, dyads, annotations)
    name = F.concat_ws("/", "dyad_id", "side")
    cut = settle(aligned.samples.select(name.alias("rec_id"), "t", "x"))
    sides = align.sides(dyads).drop("role").withColumn("_new", F.concat_ws("/", "dyad_id", "side"))
    rates = sides.join(recordings.select("rec_id", "sfreq"), "rec_id").select(F.col("_new").alias("rec_id"), "sfreq")
    shapes = settle(align.lengths(cut).join(rates, "rec_id"))
    renamed = sides.join(channels, "rec_id").withColumn("rec_id", F.col("_new")).select(*channels.columns)
    return clean(cut, shapes, renamed, montage, **options), aligned.segments
