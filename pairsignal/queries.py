"""Named queries over the test tables, one per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsignal import fixtures as fx
from pairsignal.functions import text
from pairsignal.functions.vectors import cosine, half
from pairsignal.operators import align, channels, compare, decompose, embed, filters, interpolate, knn, prepare, quality, remix, report, score, synchrony
from pairsignal.operators.blocks import ROW_NUMBERS
from pairsignal.plans import clean as clean_plan
from pairsignal.plans import train as train_plan
from pairsignal.session import ensure_checkpoint_dir, settle
from pairsignal.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Fixed values of the queries.
TAPS = [-0.05, -0.25, 0.6, -0.25, -0.05]
SMOOTH = [0.2, 0.2, 0.2, 0.2, 0.2]
TRIM = 20
WINDOW = 10.0
NEIGHBOURS = 3
MANY_NEIGHBOURS = 100
DIGITS = 6
LABEL_BATCH = 64
DESIGN_SFREQ = 8.0
SYNC_WINDOW, SYNC_LAG = 10, 2


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, DIGITS)


def _long(df: DataFrame, *keys: str, index: str = "ch_idx") -> DataFrame:
    return df.select(*keys, F.posexplode("x").alias(index, "x"))


def _paired(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dense samples with their recordings and dyads."""
    recordings = settle(fx.user_recordings(spark, sf))
    return fx.dense(spark, sf), recordings, settle(fx.dyads_of(recordings))


def _ragged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    long = fx.ragged(spark, sf)
    recordings = settle(fx.ragged_recordings(spark, sf))
    return long, recordings, settle(fx.dyads_of(recordings))


def _aligned(spark: SparkSession, sf: str) -> align.Aligned:
    samples, recordings, dyads = _paired(spark, sf)
    return align.mutually_align(samples, recordings, dyads, fx.error_annotations(spark, sf))


def _crowd(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fx.crowd(spark, sf), settle(fx.crowd_recordings(spark, sf))


def _usable(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    samples, recordings = _crowd(spark, sf)
    unusable = settle(quality.bad_by_nan(samples).unionByName(quality.bad_by_flat(samples, recordings)))
    return quality.mask_channels(samples, unusable, recordings), recordings


def _vector_lengths(vectors: DataFrame) -> DataFrame:
    return settle(vectors.groupBy("pairing").agg((F.max("t") + 1).alias("n_samples")))


# Channels

def _total(x):
    """Sum of an array's elements, in their order."""
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


@query
def rename_channels(spark: SparkSession, sf: str) -> DataFrame:
    names = fx.names(spark, sf).withColumn("old", F.col("ch"))
    return channels.rename_channels(names).select("rec_id", "ch_key", "old", "ch", "skipped")


@query
def duplicate_channels(spark: SparkSession, sf: str) -> DataFrame:
    return channels.duplicate_channels(channels.rename_channels(fx.names(spark, sf)))


@query
def pick_channels(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings, _ = _paired(spark, sf)
    kinds = F.array(*[F.struct(F.lit(i).alias("ch_idx"), F.lit(c).alias("ch"), F.lit("misc" if c == "error" else "eeg").alias("type"))
                      for i, c in enumerate(fx.EVENT_CHANNELS)])
    table = recordings.select("rec_id", F.inline(kinds))
    return _long(channels.pick_channels(samples, table, recordings), "rec_id", "t")


@query
def recording_shapes(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.dense(spark, sf)
    return align.lengths(samples).withColumn("seconds", r6(F.col("n_samples") * float(fx.BIN_SECONDS)))


# Lengths, stacking, scaling

@query
def align_lengths(spark: SparkSession, sf: str) -> DataFrame:
    long, recordings, dyads = _ragged(spark, sf)
    return prepare.align_lengths(long, dyads, recordings).select("dyad_id", "side", "rec_id", "ch", "t", "x")


@query
def stack_channels(spark: SparkSession, sf: str) -> DataFrame:
    long, recordings, dyads = _ragged(spark, sf)
    return prepare.stack_long(prepare.align_lengths(long, dyads, recordings), dyads, recordings)


@query
def minmax_per_channel(spark: SparkSession, sf: str) -> DataFrame:
    long, recordings, dyads = _ragged(spark, sf)
    stacked = prepare.stack_long(prepare.align_lengths(long, dyads, recordings), dyads, recordings)
    return prepare.minmax_long(stacked, dyads).select("dyad_id", "gch_idx", "t", r6("x").alias("x"))


@query
def prepare_grid(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings, dyads = _paired(spark, sf)
    trimmed = prepare.middle_trim(samples, recordings, F.lit(TRIM))
    both = samples.withColumn("clean", F.lit("zeropad_30")).unionByName(trimmed.withColumn("clean", F.lit("cut_60")))
    cells = dyads.select(F.explode(F.array(F.lit("zeropad_30"), F.lit("cut_60"))).alias("clean"), "pairing", "rec_a", "rec_b")
    grid = prepare.prepare_grid(both, cells)
    return _long(grid, "clean", "scaling", "pairing", "t", index="gch_idx").withColumn("x", r6("x"))


@query
def stack_in_time(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings, dyads = _paired(spark, sf)
    names = recordings.select("rec_id", F.array(*[F.lit(c) for c in fx.EVENT_CHANNELS]).alias("names"))
    pairs = dyads.select(F.col("dyad_id").alias("out_id"), F.col("rec_a").alias("rec_1"), F.col("rec_b").alias("rec_2"))
    return _long(prepare.stack_in_time(samples, pairs, names, recordings), "rec_id", "t")


@query
def orient_wide(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.dense(spark, sf)
    wide = prepare.to_wide(prepare.to_long(samples))
    return wide.select("rec_id", "t", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(len(fx.EVENT_CHANNELS))])


@query
def flatten_long(spark: SparkSession, sf: str) -> DataFrame:
    samples = fx.dense(spark, sf)
    return prepare.flatten(samples).select("rec_id", "row", "x")


@query
def middle_trim(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings, _ = _paired(spark, sf)
    return _long(prepare.middle_trim(samples, recordings, F.lit(TRIM)), "rec_id", "t")


@query
def half_precision(spark: SparkSession, sf: str) -> DataFrame:
    vectors = fx.vectors(spark, sf).select("t", half("e").alias("h"))
    return vectors.select("t", F.posexplode(F.col("h").cast("array<double>")).alias("dim", "h"))


# Splits and labels

@query
def temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    long, recordings, _ = _ragged(spark, sf)
    return prepare.time_split(long, recordings).select("rec_id", "ch", "t", "split")


@query
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    long, recordings, _ = _ragged(spark, sf)
    return score.split_counts(prepare.time_split(long, recordings), ["rec_id"])


@query
def segment_sixths(spark: SparkSession, sf: str) -> DataFrame:
    long, recordings, _ = _ragged(spark, sf)
    return prepare.sixths(long, recordings).select("rec_id", "ch", "t", "part")


@query
def pick_times(spark: SparkSession, sf: str) -> DataFrame:
    samples, _, dyads = _paired(spark, sf)
    rates = dyads.select("dyad_id", F.lit(1.0).alias("sfreq"))
    ends = align.segments(align.time_map(align.blank_mask(samples, dyads)), rates, dyads)
    first = F.col("dyad_id").cast("bigint") * 2
    times = ends.filter("kind = 'keep'").select(F.explode(F.array(first.cast("string"), (first + 1).cast("string"))).alias("rec_id"), F.col("start_t").alias("t"))
    return _long(prepare.pick_times(samples, times), "rec_id", "t")


@query
def role_labels(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings, dyads = _paired(spark, sf)
    roles = prepare.channel_roles(dyads, recordings)
    labelled = prepare.label_samples(prepare.stack_wide(samples, dyads), roles, dyads)
    return labelled.withColumn("y", F.col("y").cast("int"))


@query
def distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings, dyads = _paired(spark, sf)
    roles = prepare.channel_roles(dyads, recordings)
    labelled = prepare.label_samples(prepare.stack_wide(samples, dyads), roles, dyads)
    return labelled.select("dyad_id", F.col("y").cast("int").alias("y")).distinct()


@query
def repeat_tile(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings, dyads = _paired(spark, sf)
    embedded = prepare.stack_wide(samples, dyads).select("dyad_id", "t", r6(_total(F.col("x"))).alias("e0"))
    tiled = prepare.repeat_over_channels(embedded, prepare.channel_roles(dyads, recordings), dyads)
    return tiled.withColumn("y", F.col("y").cast("int"))


# Mutual alignment

@query
def annotation_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return align.annotation_edges(fx.error_annotations(spark, sf), fx.user_recordings(spark, sf))


@query
def pad_and_zero_annotations(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings, dyads = _paired(spark, sf)
    zeroed = align.zero_annotated(samples, align.annotation_edges(fx.error_annotations(spark, sf), recordings))
    active = settle(fx.active_lengths(spark, sf).join(recordings.drop("n_samples"), "rec_id"))
    cut = prepare.attach(zeroed, active.select("rec_id", "n_samples"), "rec_id", bound=recordings).filter("t < n_samples").drop("n_samples")
    return _long(align.pad_lengths(cut, dyads, active), "dyad_id", "side", "t")


@query
def blank_mask(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings, dyads = _paired(spark, sf)
    edges = align.annotation_edges(fx.error_annotations(spark, sf), recordings)
    return align.blank_mask(samples, dyads, edges).select("dyad_id", "t", "cut")


@query
def run_edges(spark: SparkSession, sf: str) -> DataFrame:
    samples, _, dyads = _paired(spark, sf)
    return align.run_edges(align.blank_mask(samples, dyads))


@query
def cut_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf).segments.filter("kind = 'cut'").withColumns({c: r6(c) for c in ("onset_src", "onset_dst", "duration_s")})


@query
def keep_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf).segments.filter("kind = 'keep'").withColumns({c: r6(c) for c in ("onset_src", "onset_dst", "duration_s")})


@query
def shared_annotations(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf).annotations.withColumns({c: r6(c) for c in ("onset_s", "onset_dst", "duration_s")})


@query
def mutual_align(spark: SparkSession, sf: str) -> DataFrame:
    return _long(_aligned(spark, sf).samples, "dyad_id", "rec_id", "side", "t")


@query
def aligned_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Blank parts cut from both sides, channels stacked, each channel scaled: the flagship."""
    samples, recordings, dyads = _paired(spark, sf)
    aligned = align.mutually_align(samples, recordings, dyads, fx.error_annotations(spark, sf))
    stacked = prepare.stack_aligned(aligned.samples)
    scaled = prepare.minmax_wide(stacked, ["dyad_id"], dyads)
    return _long(scaled, "dyad_id", "t", index="gch_idx").withColumn("x", r6("x"))


# Grid bookkeeping

def _cells(spark: SparkSession, sf: str) -> DataFrame:
    dyads = settle(fx.user_dyads(spark, sf))
    scalings = F.array(*[F.lit(s) for s in prepare.SCALINGS])
    kinds = F.array(*[F.lit(c) for c in fx.EVENT_CHANNELS])
    return dyads.select(F.explode(kinds).alias("clean"), "pairing", "rec_a", "rec_b").withColumn("scaling", F.explode(scalings))


def _present(spark: SparkSession, sf: str) -> DataFrame:
    """Cells whose two users each have at least ten events of the cell's type."""
    counts = fx.table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("rec_id"), F.col("event_type").alias("clean")).agg(
        F.count(F.lit(1)).alias("n")
    ).filter("n >= 10").drop("n")
    cells = _cells(spark, sf)
    return (
        cells.join(counts.withColumnRenamed("rec_id", "rec_a"), ["clean", "rec_a"], "left_semi")
        .join(counts.withColumnRenamed("rec_id", "rec_b"), ["clean", "rec_b"], "left_semi")
        .select("clean", "scaling", "pairing")
    )


@query
def missing_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.skip_cells(_cells(spark, sf), _present(spark, sf)).select("clean", "scaling", "pairing")


@query
def skip_tags(spark: SparkSession, sf: str) -> DataFrame:
    quiet = fx.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n < 60")
    cells = _cells(spark, sf).select("clean", "scaling", "pairing", "rec_a")
    excluded = cells.join(quiet.select(F.col("user_id").cast("string").alias("rec_a")), "rec_a", "left_semi").filter("scaling = 'normalized'")
    return prepare.skip_cells(cells, excluded).select("clean", "scaling", "pairing")


@query
def pairing_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("pairing")
    return fx.user_dyads(spark, sf).select(
        "pairing",
        *[text.pairing_part(p, side, what).alias(f"{what}_{side}") for side in "ab" for what in ("role", "subject")],
    )


@query
def file_names(spark: SparkSession, sf: str) -> DataFrame:
    pages = fx.table(spark, sf, "pages").select("page_id", "url")
    return pages.select(
        "page_id", text.base_name(F.col("url")).alias("base"), text.stem(F.col("url")).alias("stem"), text.cleaned_name(F.col("url")).alias("cleaned")
    )


# Filters and channel quality

@query
def fir_highpass(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings, _ = _paired(spark, sf)
    return _long(filters.fir(samples, recordings, TAPS), "rec_id", "t").withColumn("x", r6("x"))


@query
def highpass_designed(spark: SparkSession, sf: str) -> DataFrame:
    """The high-pass of the cleaning run, designed for the recordings' rate."""
    samples, recordings, _ = _paired(spark, sf)
    return _long(filters.band(samples, recordings.withColumn("sfreq", F.lit(DESIGN_SFREQ))), "rec_id", "t").withColumn("x", r6("x"))


@query
def bad_nan(spark: SparkSession, sf: str) -> DataFrame:
    return quality.bad_by_nan(fx.crowd(spark, sf))


@query
def bad_flat(spark: SparkSession, sf: str) -> DataFrame:
    return quality.bad_by_flat(*_crowd(spark, sf))


@query
def channel_spread(spark: SparkSession, sf: str) -> DataFrame:
    flat = quality.flatness(*_crowd(spark, sf))
    return flat.select("rec_id", "ch_idx", r6("sd").alias("sd"), r6("mad").alias("mad"))


@query
def bad_deviation(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.deviation(*_usable(spark, sf))
    return found.select("rec_id", "ch_idx", F.round("amp", 9).alias("amp"), r6("z").alias("z"), (F.abs("z") > quality.Z_LIMIT).alias("bad"))


@query
def bad_hf_noise(spark: SparkSession, sf: str) -> DataFrame:
    found = quality.hf_noise(*_usable(spark, sf), SMOOTH)
    return found.select("rec_id", "ch_idx", r6("noise").alias("noise"), r6("z").alias("z"), (F.col("z") > quality.Z_LIMIT).alias("bad"))


@query
def bad_correlation(spark: SparkSession, sf: str) -> DataFrame:
    windows = quality.window_correlations(*_usable(spark, sf), WINDOW)
    return quality.low_fraction(windows, quality.CORR_LIMIT).select(
        "rec_id", "ch_idx", r6("fraction").alias("fraction"), (F.col("fraction") > quality.CORR_FRACTION).alias("bad")
    )


@query
def window_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return quality.window_correlations(*_usable(spark, sf), WINDOW).withColumn("corr", r6("corr"))


@query
def bad_union(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings = _crowd(spark, sf)
    unusable = settle(quality.bad_by_nan(samples).unionByName(quality.bad_by_flat(samples, recordings)))
    rest = quality.mask_channels(samples, unusable, recordings)
    every = unusable.unionByName(quality.bad_by_deviation(rest, recordings))
    return quality.bad_summary(every).select("rec_id", "n_bad", F.array_join(F.col("channels").cast("array<string>"), ",").alias("channels"))


def _five_criteria(spark: SparkSession, sf: str) -> DataFrame:
    """All criteria but the one that draws channels."""
    samples, recordings = _crowd(spark, sf)
    unusable = settle(quality.bad_by_nan(samples).unionByName(quality.bad_by_flat(samples, recordings)))
    rest = settle(quality.mask_channels(samples, unusable, recordings))
    found = unusable.unionByName(quality.bad_by_deviation(rest, recordings)).unionByName(quality.bad_by_hf_noise(rest, recordings, SMOOTH))
    return settle(found.unionByName(quality.bad_by_correlation(rest, recordings, WINDOW)))


@query
def bad_channels(spark: SparkSession, sf: str) -> DataFrame:
    return _five_criteria(spark, sf)


@query
def cleaning_log(spark: SparkSession, sf: str) -> DataFrame:
    """The audit record of a cleaning run, one row per step: what was found bad and what a person excluded."""
    recordings = settle(fx.crowd_recordings(spark, sf))
    listed = settle(fx.crowd_exclusions(spark, sf).select("rec_id", text.exclusion_list(F.col("listed")).alias("comps")))
    state = recordings.select("rec_id", F.lit(True).alias("done"))
    log = clean_plan.cleaning_log(recordings, _five_criteria(spark, sf), listed, state, filters.HIGHPASS_HZ, 4)
    named = ["n_channels", "l_freq", "n_bad_channels", "n_interpolated", "n_components", "excluded_components"]
    return log.select("original_file", F.posexplode("steps").alias("pos", "s")).select(
        "original_file", "pos", F.col("s.step").alias("step"), F.col("s.description").alias("description"),
        F.coalesce(*[F.col("s.params")[n] for n in named]).alias("param"), F.col("s.params")["hf_noise"].alias("noisy"),
    )


@query
def bad_ransac(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings = _usable(spark, sf)
    table = settle(fx.crowd_channels(spark, sf))
    found = quality.ransac_correlations(samples, table, fx.spiral_montage(table), recordings, 2 * WINDOW)
    return quality.low_fraction(found, quality.RANSAC_CORR)


@query
def interpolate_bads(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings = _crowd(spark, sf)
    table = settle(fx.crowd_channels(spark, sf))
    bad = quality.bad_by_nan(samples).unionByName(quality.bad_by_flat(samples, recordings))
    repaired, _ = interpolate.interpolate_bads(samples, settle(interpolate.mark_bad(table, bad)), fx.spiral_montage(table), recordings)
    return _long(repaired, "rec_id", "t")


@query
def remix_matrix(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings, _ = _paired(spark, sf)
    width = len(fx.EVENT_CHANNELS)
    rows = recordings.select("rec_id", F.explode(F.array(*[F.lit(i) for i in range(width)])).alias("out_idx"))
    weights = rows.withColumn("w", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.lit(1.0) / (1 + F.abs(j - F.col("out_idx")))))
    return _long(remix.project(samples, weights, recordings), "rec_id", "t").withColumn("x", r6("x"))


@query
def ica_clean(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings, _ = _paired(spark, sf)
    state = decompose.fit_components(samples, recordings, 4)
    listed = fx.exclusion_texts(spark, sf).select("rec_id", text.exclusion_list(F.col("listed")).alias("comps"))
    return _long(decompose.remove_components(samples, state, settle(listed), recordings), "rec_id", "t")


@query
def clean_recordings(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings = fx.crowd(spark, sf), settle(fx.crowd_recordings(spark, sf))
    table = settle(fx.crowd_channels(spark, sf))
    listed = fx.crowd_exclusions(spark, sf).select("rec_id", text.exclusion_list(F.col("listed")).alias("comps"))
    cleaned = clean_plan.clean(
        samples, recordings, table, fx.spiral_montage(table), settle(listed), taps=TAPS, hf_taps=SMOOTH, corr_seconds=WINDOW,
        ransac_seconds=2 * WINDOW, n_components=4,
    )
    return _long(cleaned.samples, "rec_id", "t")


# Embeddings

@query
def receptive_field(spark: SparkSession, sf: str) -> DataFrame:
    runs = fx.runs(spark, sf).select(F.col("run_id").cast("string").alias("rec_id"), "t", F.col("e").alias("x"))
    return _long(embed.receptive_field(runs), "rec_id", "t", index="feature").withColumn("x", r6("x"))


@query
def positive_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = embed.positive_pairs(fx.vectors(spark, sf))
    return pairs.select("t", "t_pos", r6(cosine(F.col("e"), F.col("e_pos"))).alias("sim"))


def _halves(v: DataFrame) -> DataFrame:
    """``y`` from the first half of a vector and ``target`` from the other."""
    half = fx.DIMS // 2
    return v.select("pairing", "t", _total(F.slice("e", 1, half)).alias("y"), _total(F.slice("e", half + 1, half)).alias("target"))


@query
def nearest_label(spark: SparkSession, sf: str) -> DataFrame:
    v = _halves(fx.vectors(spark, sf))
    found = embed.nearest(v.select("pairing", "t", "target"), v.select("pairing", "t", "y"), _vector_lengths(v), "pairing")
    return found.select("t", "t_pos", r6("target").alias("target"), r6("y_pos").alias("y_pos"))


@query
def nearest_label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    v = _whole_label(fx.vectors(spark, sf)).select("pairing", "t", "y")
    return embed.nearest_label_pairs(v, _vector_lengths(v))


def _whole_label(v: DataFrame) -> DataFrame:
    """``y`` from the whole vector, in whole numbers so that every order of summing gives the same."""
    return v.withColumn("y", _total(F.transform("e", lambda x: F.floor(x * 1000).cast("double"))))


@query
def embed_label_delta(spark: SparkSession, sf: str) -> DataFrame:
    v = _whole_label(fx.vectors(spark, sf))
    lengths = settle(_vector_lengths(v).withColumn("n_train", F.col("n_samples")))
    made = embed.embed_linear(v.select("pairing", "t", F.col("e").alias("x"), "y"), lengths, "delta", runs=2)
    return made.select("pairing", "run_id", "t", F.posexplode("e").alias("dim", "e"))


@query
def embed_linear(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings, dyads = _paired(spark, sf)
    inputs, lengths = train_plan.inputs(prepare.stack_wide(samples, dyads), dyads, recordings)
    return embed.embed_linear(inputs, lengths).select("pairing", "run_id", "t", F.posexplode("e").alias("dim", "e"))


@query
def score_pairings(spark: SparkSession, sf: str) -> DataFrame:
    samples, recordings, dyads = _paired(spark, sf)
    inputs, lengths, labels = train_plan.flat_inputs(prepare.stack_wide(samples, dyads), dyads, recordings, packed=True)
    return train_plan.embed_and_score(inputs, lengths, labels).metrics


# Scores

def _neighbours(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    vectors = fx.vectors(spark, sf)
    return vectors, knn.nearest_neighbours(vectors.filter("split = 'train'"), vectors.filter("split = 'test'"), NEIGHBOURS)


@query
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf)[1].select("qid", "rank", "nid", r6("sim").alias("sim"))


@query
def knn_decode(spark: SparkSession, sf: str) -> DataFrame:
    return knn.vote(_neighbours(spark, sf)[1]).select("qid", "pred", "votes")


@query
def knn_sqrt(spark: SparkSession, sf: str) -> DataFrame:
    """As many neighbours as the square root of the training rows."""
    vectors = fx.vectors(spark, sf)
    return knn.decode(vectors.filter("split = 'train'"), vectors.filter("split = 'test'"), "sqrt").select("qid", "pred", "votes")


@query
def knn_counted(spark: SparkSession, sf: str) -> DataFrame:
    vectors = fx.vectors(spark, sf)
    found = knn.counted_vote(vectors.filter("split = 'train'"), vectors.filter("split = 'test'"), MANY_NEIGHBOURS)
    return found.select("qid", "pred", "votes")


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    vectors, found = _neighbours(spark, sf)
    return knn.vote(found).join(vectors.select("pairing", "run_id", F.col("t").alias("qid"), "label"), ["pairing", "run_id", "qid"])


@query
def decoding_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return score.accuracy(_decoded(spark, sf), ["pairing"]).withColumn("accuracy", r6("accuracy"))


@query
def decoding_r2(spark: SparkSession, sf: str) -> DataFrame:
    return score.r_squared(_decoded(spark, sf), ["pairing"], "label", "pred").withColumn("r2", r6("r2"))


@query
def infonce_bits(spark: SparkSession, sf: str) -> DataFrame:
    vectors = fx.vectors(spark, sf)
    found = score.infonce(vectors, _vector_lengths(vectors))
    return found.select("pairing", "run_id", "n", r6("loss").alias("loss"), r6("bits").alias("bits"))


@query
def infonce_labelled(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _whole_label(fx.vectors(spark, sf))
    found = score.infonce_labelled(vectors, _vector_lengths(vectors), batch=LABEL_BATCH)
    return found.select("pairing", "run_id", "n", r6("loss").alias("loss"), r6("bits").alias("bits"))


@query
def infonce_classes(spark: SparkSession, sf: str) -> DataFrame:
    vectors = fx.vectors(spark, sf).withColumn("y", F.col("label"))
    found = score.infonce_labelled(vectors, _vector_lengths(vectors), batch=LABEL_BATCH)
    return found.select("pairing", "run_id", "n", r6("loss").alias("loss"), r6("bits").alias("bits"))


def _history(spark: SparkSession, sf: str) -> DataFrame:
    return fx.ragged(spark, sf).select(
        F.col("rec_id").alias("pairing"), F.col("ch_idx").alias("run_id"), F.col("t").cast("int").alias("iter"), F.log1p("x").alias("loss")
    )


@query
def fit_history(spark: SparkSession, sf: str) -> DataFrame:
    return score.fit_history(_history(spark, sf)).select("pairing", "run_id", "iter", r6("bits").alias("bits"))


@query
def history_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = score.history_summary(score.fit_history(_history(spark, sf)))
    return found.select("pairing", "run_id", "n_iter", r6("best_bits").alias("best_bits"), r6("last_bits").alias("last_bits"))


@query
def run_consistency(spark: SparkSession, sf: str) -> DataFrame:
    found = score.run_consistency(fx.runs(spark, sf))
    return found.select("pairing", "run_i", "run_j", "n", r6("r2").alias("r2"), r6("r2_weighted").alias("r2_weighted"))


@query
def variability(spark: SparkSession, sf: str) -> DataFrame:
    found = score.variability(score.run_consistency(fx.runs(spark, sf)))
    return found.select("pairing", r6("mean_consistency").alias("mean_consistency"), r6("variability").alias("variability"))


def _side_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Consistency of the two sides of each dyad, each as two runs of three channels with the third in common."""
    samples, _, dyads = _paired(spark, sf)
    both = align.attach(samples, align.sides(dyads).join(dyads.select("dyad_id", "pairing"), "dyad_id"), "rec_id", bound=dyads, numbers=2 * ROW_NUMBERS)
    side = (F.col("side") == "b").cast("int") * 2
    runs = both.select("pairing", "t", "x", side.alias("side"), F.explode(F.array(F.lit(0), F.lit(1))).alias("part")).select(
        "pairing", (F.col("side") + F.col("part")).alias("run_id"), "t", F.slice("x", 2 * F.col("part") + 1, 3).alias("e")
    )
    return score.variability(score.run_consistency(runs))


@query
def side_variability(spark: SparkSession, sf: str) -> DataFrame:
    return _side_consistency(spark, sf).select("pairing", r6("mean_consistency").alias("mean_consistency"), r6("variability").alias("variability"))


@query
def result_lines(spark: SparkSession, sf: str) -> DataFrame:
    tagged = _side_consistency(spark, sf).withColumn("tag", F.concat(F.lit("zeropad_30/raw/"), "pairing"))
    return report.result_lines(tagged)


@query
def class_distance(spark: SparkSession, sf: str) -> DataFrame:
    return score.class_distance(fx.vectors(spark, sf), ["pairing"]).withColumns({c: r6(c) for c in ("intra", "inter")})


@query
def l1_regression(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.vectors(spark, sf).withColumn("y", F.col("label").cast("double"))
    return score.l1_regression(rows, 0.01).select("pairing", "run_id", "intercept", F.posexplode("coef").alias("dim", "coef"))


@query
def decode_continuous(spark: SparkSession, sf: str) -> DataFrame:
    vectors = fx.vectors(spark, sf)
    traits = vectors.select("pairing", "t", F.col("label").cast("double").alias("y"))
    return score.decode_continuous(vectors, traits, 0.01)


# Synchrony and groups

def _synchrony(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    samples, _, dyads = _paired(spark, sf)
    return synchrony.window_synchrony(samples, dyads, SYNC_WINDOW, SYNC_LAG), dyads


@query
def window_synchrony(spark: SparkSession, sf: str) -> DataFrame:
    return _synchrony(spark, sf)[0].withColumn("r", r6("r"))


@query
def synchrony_by_leader(spark: SparkSession, sf: str) -> DataFrame:
    return synchrony.synchrony_by_leader(*_synchrony(spark, sf)).withColumn("r", r6("r"))


def _run_values(spark: SparkSession, sf: str) -> DataFrame:
    """A whole-number metric of each user's run (event type): the mean value in hundredths; users alternate in two groups."""
    long = fx.ragged(spark, sf)
    cents = F.round(F.col("x") * 100).cast("bigint")
    found = long.groupBy(F.col("rec_id").alias("pairing"), F.col("ch_idx").alias("run_id")).agg(F.sum(cents).alias("s"), F.count(F.lit(1)).alias("n"))
    return found.select(
        F.when(F.col("pairing").cast("bigint") % 2 == 0, "even").otherwise("odd").alias("grp"), "pairing", "run_id", F.expr("s div n").alias("value")
    )


@query
def metrics_rollup(spark: SparkSession, sf: str) -> DataFrame:
    found = compare.metrics_rollup(_run_values(spark, sf), ["grp", "pairing", "run_id"], "value")
    return found.withColumns({"run_id": F.col("run_id").cast("string"), "mean": r6("mean"), "sd": r6("sd")})


@query
def group_comparison(spark: SparkSession, sf: str) -> DataFrame:
    units = _run_values(spark, sf).groupBy("grp", "pairing").agg(F.sum("value").alias("value")).withColumn("unit", F.col("pairing").cast("bigint"))
    found = compare.group_comparison(units, "even")
    return found.withColumns({c: r6(c) for c in ("mean_first", "mean_rest", "difference", "p")})


@query
def recorded_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows written twice, as by a rerun, and read back: every row once."""
    path = f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    rows = _run_values(spark, sf).select("grp", "run_id", "pairing", "value")
    for _ in range(2):
        tables.record_runs(rows, path, ["grp", "run_id"])
    return tables.read_runs(spark, path, "pairing string, value bigint, grp string, run_id int")


# Runs and reports

def _status(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Runs of users, one per event type; a run is expected for every type and fails if it has fewer than ten rows."""
    long = fx.ragged(spark, sf)
    embedded = long.select(F.col("rec_id").alias("pairing"), F.col("ch_idx").alias("run_id"), "t", F.array("x").alias("e"))
    expected = embedded.select("pairing").distinct().withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(len(fx.EVENT_CHANNELS) - 1))))
    enough = embedded.groupBy("pairing", "run_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10").drop("n")
    done = embedded.join(enough, ["pairing", "run_id"], "left_semi")
    return embedded, score.run_status(expected, done)


@query
def run_status_filter(spark: SparkSession, sf: str) -> DataFrame:
    embedded, status = _status(spark, sf)
    kept = score.successful_runs(embedded, status)
    return kept.groupBy("pairing").agg(F.count_distinct("run_id").alias("n_runs"), F.count(F.lit(1)).alias("n_rows"))


@query
def metrics_summary(spark: SparkSession, sf: str) -> DataFrame:
    embedded, status = _status(spark, sf)
    found = score.successful_runs(embedded, status).groupBy("pairing", "run_id").agg(
        F.avg(F.get("e", F.lit(0))).alias("acc_val"), F.max("t").alias("n_val")
    )
    summary = report.metrics_summary(status, found, ["acc_val", "n_val"], ["pairing", "run_id"])
    return summary.select("pairing", "run_id", r6("acc_val").alias("acc_val"), "n_val", F.isnan("acc_val").alias("absent")).withColumns(
        {c: F.nanvl(F.col(c), F.lit(-1.0)) for c in ("acc_val", "n_val")}
    )


@query
def pairing_report(spark: SparkSession, sf: str) -> DataFrame:
    embedded, status = _status(spark, sf)
    found = score.successful_runs(embedded, status).groupBy("pairing", "run_id").agg(F.avg(F.get("e", F.lit(0))).alias("acc_val"))
    summary = report.metrics_summary(status, found, ["acc_val"], ["pairing", "run_id"])
    return report.pairing_report(summary, ["acc_val"]).withColumn("acc_val", r6("acc_val"))


@query
def metrics_json(spark: SparkSession, sf: str) -> DataFrame:
    long = fx.ragged(spark, sf)
    found = long.groupBy(F.col("rec_id").alias("pairing"), F.col("ch_idx").alias("run_id")).agg(
        F.count(F.lit(1)).alias("n_val"), F.max(F.when(F.col("t") >= 10, F.col("x"))).alias("late")
    )
    keys = ["pairing", "run_id"]
    return report.from_json(report.as_json(found, keys), keys, "n_val bigint, late double, absent double")


@query
def exclusion_parse(spark: SparkSession, sf: str) -> DataFrame:
    listed = fx.exclusion_texts(spark, sf)
    return listed.select("rec_id", "listed", F.array_join(text.exclusion_list(F.col("listed")).cast("array<string>"), ",").alias("comps"))


@query
def processing_log(spark: SparkSession, sf: str) -> DataFrame:
    users = fx.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("c"))
    rec = F.concat(F.lit("user"), F.col("user_id"), F.lit(".edf"))
    entries = users.select(
        rec.alias("original_file"),
        F.explode(
            F.array(
                report.step(2, "select", F.lit("Kept event types"), {"n_channels": F.col("c")}),
                report.step(1, "load", F.concat(F.lit("Loaded "), F.col("n"), F.lit(" events")), {"n_events": F.col("n")}),
            )
        ).alias("entry"),
    )
    log = report.processing_log(entries, F.lit("2024-01-31T00:00:00"))
    return log.select("original_file", "ts", F.posexplode("steps").alias("pos", "s")).select(
        "original_file", "ts", "pos", F.col("s.step").alias("step"), F.col("s.description").alias("description"),
        F.coalesce(F.col("s.params")["n_events"], F.col("s.params")["n_channels"]).alias("param"),
    )
