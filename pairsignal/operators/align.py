"""Mutual alignment of the two recordings of a dyad: blanks, cut and keep segments, re-indexed samples."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairsignal.functions.vectors import seconds_to_sample
from pairsignal.operators.blocks import BLOCK, ROW_NUMBERS, attach, block_of, running_sums, with_halo
from pairsignal.session import settle

CUT = "cut"


class Aligned(NamedTuple):
    samples: DataFrame       # dyad_id, rec_id, side, t, x
    segments: DataFrame      # SEGMENTS
    annotations: DataFrame   # rec_id, dyad_id, onset_s (before removal), onset_dst, duration_s, description


def lengths(samples: DataFrame) -> DataFrame:
    """Shape of each recording: samples, channels."""
    return samples.groupBy("rec_id").agg(
        (F.max("t") + 1).alias("n_samples"), F.max(F.size("x")).alias("n_channels")
    )


def sides(dyads: DataFrame) -> DataFrame:
    """Two rows per dyad: ``dyad_id, side, rec_id, role``."""
    return dyads.select(
        "dyad_id",
        F.inline(
            F.array(
                F.struct(F.lit("a").alias("side"), F.col("rec_a").alias("rec_id"), F.col("role_a").alias("role")),
                F.struct(F.lit("b").alias("side"), F.col("rec_b").alias("rec_id"), F.col("role_b").alias("role")),
            )
        ),
    )


def annotation_edges(annotations: DataFrame, recordings: DataFrame, description: str | None = None) -> DataFrame:
    """Each annotated range as +1 at its first sample and -1 after its last: ``rec_id, t, delta``.

    Overlaps add up, empty ranges vanish, a negative onset starts at 0.
    """
    chosen = annotations if description is None else annotations.filter(F.col("description") == description)
    rated = chosen.join(recordings.select("rec_id", "sfreq"), "rec_id")
    start = F.greatest(seconds_to_sample(F.col("onset_s"), F.col("sfreq")), F.lit(0).cast("bigint"))
    stop = seconds_to_sample(F.col("onset_s") + F.col("duration_s"), F.col("sfreq"))
    ranges = rated.select("rec_id", start.alias("s"), stop.alias("e")).filter("e > s")
    edges = ranges.select(
        "rec_id",
        F.inline(
            F.array(
                F.struct(F.col("s").alias("t"), F.lit(1).cast("bigint").alias("delta")),
                F.struct(F.col("e").alias("t"), F.lit(-1).cast("bigint").alias("delta")),
            )
        ),
    )
    return edges.groupBy("rec_id", "t").agg(F.sum("delta").alias("delta"))


def zero_annotated(samples: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Set every channel to 0 inside annotated ranges.

    Counting range edges along time replaces the range join, so many overlapping ranges cost no more than few.
    """
    rows = samples.select("rec_id", "t", F.lit(1).alias("kind"), "x", F.lit(0).cast("bigint").alias("delta"))
    marks = edges.select("rec_id", "t", F.lit(0).alias("kind"), F.lit(None).cast("array<double>").alias("x"), "delta")
    both = rows.unionByName(marks).withColumn("block", block_of("t", block))
    open_ranges = running_sums(both, ["rec_id"], {"open": F.col("delta")}, ("t", "kind"))
    return open_ranges.filter("kind = 1").select(
        "rec_id", "t", F.when(F.col("open") > 0, F.transform("x", lambda v: F.lit(0.0))).otherwise(F.col("x")).alias("x")
    )


def pad_lengths(samples: DataFrame, dyads: DataFrame, recordings: DataFrame, block: int = BLOCK) -> DataFrame:
    """Samples of both sides, the shorter one continued with zeros: ``dyad_id, side, rec_id, t, x``."""
    shape = recordings.select("rec_id", "n_samples", "n_channels")
    both = sides(dyads).join(shape, "rec_id")
    longest = both.groupBy("dyad_id").agg(F.max("n_samples").alias("n_dyad"))
    gaps = both.join(longest, "dyad_id").filter("n_samples < n_dyad")
    pieces = gaps.withColumn("block", F.explode(F.sequence(block_of("n_samples", block), block_of(F.col("n_dyad") - 1, block))))
    first = F.greatest(F.col("n_samples"), F.col("block") * block)
    last = F.least(F.col("n_dyad"), (F.col("block") + 1) * block) - 1
    tail = pieces.withColumn("t", F.explode(F.sequence(first, last))).select(
        "dyad_id", "side", "rec_id", "t", F.array_repeat(F.lit(0.0), F.col("n_channels")).alias("x")
    )
    present = attach(samples, sides(dyads).drop("role"), "rec_id", bound=dyads, numbers=2 * ROW_NUMBERS).select("dyad_id", "side", "rec_id", "t", "x")
    return present.unionByName(tail)


def blank_mask(samples: DataFrame, dyads: DataFrame, edges: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``dyad_id, t, block, cut``: true where either side is missing, annotated, or zero in all channels.

    Only flags travel: the sample values are reduced to one boolean before the shuffle.
    """
    zero = F.forall("x", lambda v: v == 0)
    none = F.lit(0).cast("bigint")
    flags = samples.select("rec_id", "t", F.lit(1).alias("present"), zero.cast("int").alias("zero"), none.alias("delta"))
    if edges is not None:
        flags = flags.unionByName(
            edges.select("rec_id", "t", F.lit(0).alias("present"), F.lit(0).alias("zero"), "delta")
        )
    flags = attach(flags, sides(dyads).drop("role"), "rec_id", bound=dyads, numbers=2 * ROW_NUMBERS)
    columns = []
    for side in "ab":
        own = F.col("side") == side
        columns += [
            F.max(F.when(own, F.col("present")).otherwise(0)).alias(f"present_{side}"),
            F.max(F.when(own, F.col("zero")).otherwise(0)).alias(f"zero_{side}"),
            F.sum(F.when(own, F.col("delta")).otherwise(0)).alias(f"delta_{side}"),
        ]
    # One scan of the samples; everything after reads these few flags.
    by_time = settle(flags.withColumn("block", block_of("t", block)).groupBy("dyad_id", "block", "t").agg(*columns))
    blank = F.lit(False)
    if edges is not None:
        by_time = running_sums(by_time, ["dyad_id"], {f"open_{s}": F.col(f"delta_{s}") for s in "ab"})
        blank = (F.col("open_a") > 0) | (F.col("open_b") > 0)
    for side in "ab":
        blank = blank | (F.col(f"present_{side}") == 0) | (F.col(f"zero_{side}") == 1)
    return by_time.filter("present_a = 1 or present_b = 1").select("dyad_id", "t", "block", blank.alias("cut"))


def run_edges(mask: DataFrame, block: int = BLOCK) -> DataFrame:
    """Where the mask rises (+1) and falls (-1): ``dyad_id, t, edge``; a run that ends the recording falls after it."""
    spread = with_halo(mask.select("dyad_id", "t", F.col("cut").cast("int").alias("cut")), block, 1, 1)
    order = Window.partitionBy("dyad_id", "block").orderBy("t")
    seen = spread.withColumns({"before": F.lag("cut", 1, 0).over(order), "after": F.lead("cut", 1, 0).over(order)})
    core = seen.filter("core")
    rising = core.filter("cut = 1 and before = 0").select("dyad_id", "t", F.lit(1).alias("edge"))
    falling = core.filter("cut = 1 and after = 0").select("dyad_id", (F.col("t") + 1).alias("t"), F.lit(-1).alias("edge"))
    return rising.unionByName(falling)


def time_map(mask: DataFrame) -> DataFrame:
    """The mask with ``removed``: cut samples up to and including ``t``."""
    return running_sums(mask, ["dyad_id"], {"removed": F.col("cut").cast("bigint")}).select(
        "dyad_id", "t", "cut", "removed"
    )


def segments(mapped: DataFrame, rates: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """Cut and keep segments.  Within one cut run ``t - removed`` is constant, within one kept run ``removed`` is."""
    island = F.when(F.col("cut"), F.col("t") - F.col("removed")).otherwise(F.col("removed"))
    spans = mapped.groupBy("dyad_id", "cut", island.alias("island")).agg(
        F.min("t").alias("start_t"), (F.max("t") + 1).alias("end_t"), F.min("removed").alias("_removed")
    )
    before = F.when(F.col("cut"), F.col("_removed") - 1).otherwise(F.col("_removed"))
    sfreq = F.col("sfreq")
    return attach(spans, rates.select("dyad_id", "sfreq"), "dyad_id", bound=rates if bound is None else bound, spread="start_t").select(
        "dyad_id",
        F.when(F.col("cut"), F.lit("cut")).otherwise(F.lit("keep")).alias("kind"),
        "start_t",
        "end_t",
        (F.col("start_t") / sfreq).alias("onset_src"),
        ((F.col("start_t") - before) / sfreq).alias("onset_dst"),
        ((F.col("end_t") - F.col("start_t")) / sfreq).alias("duration_s"),
    )


def keep_samples(samples: DataFrame, mapped: DataFrame, dyads: DataFrame) -> DataFrame:
    """Samples of both sides outside the cuts, with time closed up."""
    kept = mapped.filter(~F.col("cut")).select("dyad_id", "t", "removed")
    both = attach(samples, sides(dyads).drop("role"), "rec_id", bound=dyads, numbers=2 * ROW_NUMBERS)
    return both.join(kept, ["dyad_id", "t"]).select(
        "dyad_id", "rec_id", "side", (F.col("t") - F.col("removed")).alias("t"), "x"
    )


def shared_annotations(found: DataFrame, dyads: DataFrame) -> DataFrame:
    """The cut list of a dyad on both of its recordings."""
    cuts = found.filter(F.col("kind") == "cut").drop("kind")
    return attach(cuts, sides(dyads).drop("role"), "dyad_id", bound=dyads, numbers=2 * ROW_NUMBERS, spread="start_t").select(
        "rec_id", "dyad_id", F.col("onset_src").alias("onset_s"), "onset_dst", "duration_s", F.lit(CUT).alias("description")
    )


def mutually_align(
    samples: DataFrame,
    recordings: DataFrame,
    dyads: DataFrame,
    annotations: DataFrame | None = None,
    description: str | None = None,
    block: int = BLOCK,
) -> Aligned:
    """Remove from both recordings of each dyad every sample at which either is blank."""
    from pairsignal.operators.channels import require_equal_sfreq

    rates = require_equal_sfreq(dyads, recordings)
    edges = None if annotations is None else annotation_edges(annotations, recordings, description)
    mapped = time_map(blank_mask(samples, dyads, edges, block))
    found = segments(mapped, rates, dyads)
    return Aligned(keep_samples(samples, mapped, dyads), found, shared_annotations(found, dyads))
