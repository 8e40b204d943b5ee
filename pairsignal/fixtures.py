"""Recordings, annotations and embeddings derived from the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsignal.operators.blocks import number_rows

# The channel order of event recordings, the sample grid and the sizes of the derived recordings.
EVENT_CHANNELS = ["click", "error", "purchase", "signup", "view"]
EPOCH = "2024-01-01 00:00:00"
BIN_SECONDS = 43200
BINS = 60
GROUP = 65             # channels of a many-channel recording
TRAIN_MODULUS = 5      # every fifth vector is held out
DIMS = 64
RUNS = 22              # runs of three elements that cover a vector; the last begins anew at its start


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds() -> Column:
    return (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))) / F.lit(1e6)


def _bin() -> Column:
    return F.floor(_seconds() / BIN_SECONDS).cast("bigint")


def _each_bin() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint")))


def channel_index(name: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in EVENT_CHANNELS]), name) - 1).cast("int")


def user_recordings(spark: SparkSession, sf_dir: str, sfreq: float = 1.0 / BIN_SECONDS) -> DataFrame:
    """One recording per user on the dense grid."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        F.col("user_id").cast("string").alias("rec_id"),
        F.lit(float(sfreq)).alias("sfreq"),
        F.lit(BINS).cast("bigint").alias("n_samples"),
        F.lit(len(EVENT_CHANNELS)).alias("n_channels"),
    )


def user_dyads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users 2k and 2k+1, both present; the even one speaks."""
    return dyads_of(user_recordings(spark, sf_dir))


def dyads_of(recordings: DataFrame) -> DataFrame:
    """Recordings named 2k and 2k+1, both present; the even one speaks."""
    users = recordings.select(F.col("rec_id").cast("bigint").alias("user_id"))
    pairs = users.groupBy(F.floor(F.col("user_id") / 2).cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    a, b = (F.col("k") * 2).cast("string"), (F.col("k") * 2 + 1).cast("string")
    return pairs.filter("n = 2").select(
        F.col("k").cast("string").alias("dyad_id"),
        F.concat(F.lit("spk"), a, F.lit("-lst"), b).alias("pairing"),
        a.alias("rec_a"),
        F.lit("speaker").alias("role_a"),
        b.alias("rec_b"),
        F.lit("listener").alias("role_b"),
    )


def ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S: long samples, the n-th event of a type of a user at t = n."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    numbered = number_rows(events, ["user_id", "event_type"], ["ts", "event_id"], _bin())
    return numbered.select(
        F.col("user_id").cast("string").alias("rec_id"),
        F.col("event_type").alias("ch"),
        channel_index(F.col("event_type")).alias("ch_idx"),
        "t",
        F.col("value").alias("x"),
    )


def ragged_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the ragged recordings: the events of the most frequent type."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(F.col("user_id").cast("string").alias("rec_id")).agg(F.max("n").alias("n_samples")).withColumn(
        "n_channels", F.lit(len(EVENT_CHANNELS))
    )


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G: wide samples, sum of values per user, 12-hour bin and event type; nothing happened is 0."""
    events = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    cells = events.groupBy("user_id", _bin().alias("t")).agg(
        *[F.sum(F.when(F.col("event_type") == c, F.col("value"))).alias(f"c{i}") for i, c in enumerate(EVENT_CHANNELS)]
    )
    grid = events.select("user_id").distinct().withColumn("t", _each_bin())
    filled = grid.join(cells, ["user_id", "t"], "left")
    return filled.select(
        F.col("user_id").cast("string").alias("rec_id"),
        "t",
        F.array(*[F.coalesce(F.col(f"c{i}"), F.lit(0.0)) for i in range(len(EVENT_CHANNELS))]).alias("x"),
    )


def error_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error event blanks 600 s per unit of its value."""
    events = table(spark, sf_dir, "events").filter("event_type = 'error'")
    return events.select(
        F.col("user_id").cast("string").alias("rec_id"),
        _seconds().alias("onset_s"),
        (F.col("value") * 600).alias("duration_s"),
        F.col("event_type").alias("description"),
    )


def crowd(spark: SparkSession, sf_dir: str, faults: bool = True) -> DataFrame:
    """M: wide samples, 65 users side by side as channels of one recording, with optional channel faults."""
    events = table(spark, sf_dir, "events").select("ts", "user_id", "value")
    sums = events.groupBy("user_id", _bin().alias("t")).agg(F.sum("value").alias("v"))
    users = events.select("user_id").distinct().withColumn("t", _each_bin())
    filled = users.join(sums, ["user_id", "t"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    if faults:
        kind = F.col("user_id") % 30
        filled = filled.withColumn(
            "v",
            F.when((kind == 0) & (F.col("t") == 7), F.lit(float("nan")))
            .when(kind == 1, F.lit(0.0))
            .when(kind == 2, F.col("v") * 50)
            .when((kind == 3) & (F.col("t") % 2 == 1), -F.col("v"))
            .otherwise(F.col("v")),
        )
    group = F.floor(F.col("user_id") / GROUP).cast("bigint")
    packed = filled.groupBy(group.cast("string").alias("rec_id"), "t").agg(
        F.sort_array(F.collect_list(F.struct("user_id", "v"))).alias("_p")
    )
    return packed.select("rec_id", "t", F.col("_p.v").alias("x"))


def crowd_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(
        F.floor(F.col("user_id") / GROUP).cast("string").alias("rec_id"),
        (F.col("user_id") % GROUP).cast("int").alias("ch_idx"),
        F.concat(F.lit("E"), F.col("user_id") % GROUP + 1).alias("ch"),
        F.lit("eeg").alias("type"),
        F.lit(False).alias("bad"),
    )


def crowd_recordings(spark: SparkSession, sf_dir: str, sfreq: float = 1.0) -> DataFrame:
    channels = crowd_channels(spark, sf_dir)
    return channels.groupBy("rec_id").agg(F.count(F.lit(1)).cast("int").alias("n_channels")).select(
        "rec_id", F.lit(float(sfreq)).alias("sfreq"), F.lit(BINS).cast("bigint").alias("n_samples"), "n_channels"
    )


def spiral_montage(channels: DataFrame) -> DataFrame:
    """Positions on the unit sphere for ``GROUP`` electrode names, along a golden-angle spiral."""
    i = F.regexp_extract("ch", r"(\d+)$", 1).cast("int") - 1
    z = 1 - (2 * i + 1) / F.lit(float(GROUP))
    phi = i * F.lit(3.141592653589793 * (3 - 5 ** 0.5))
    r = F.sqrt(1 - z * z)
    return channels.select("ch").distinct().select(
        "ch", (r * F.cos(phi)).alias("px"), (r * F.sin(phi)).alias("py"), z.alias("pz")
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N: channel names made from parts; the brand is the recording."""
    part = table(spark, sf_dir, "part")
    name = (
        F.when(F.col("p_partkey") % 50 == 0, F.lit("eeg VREF"))
        .when(F.col("p_partkey") % 7 == 0, F.col("p_name"))
        .otherwise(F.concat(F.lit("EEG "), F.col("p_size").cast("string")))
    )
    return part.select(F.col("p_brand").alias("rec_id"), F.col("p_partkey").alias("ch_key"), name.alias("ch"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: one pairing, one run; every fifth vector is validation."""
    e = table(spark, sf_dir, "embeddings")
    held_out = F.col("vec_id") % TRAIN_MODULUS == TRAIN_MODULUS - 1
    return e.select(
        F.lit("all").alias("pairing"),
        F.lit(0).alias("run_id"),
        F.col("vec_id").alias("t"),
        F.col("embedding").cast("array<double>").alias("e"),
        F.col("label").alias("label"),
        F.when(held_out, F.lit("test")).otherwise(F.lit("train")).alias("split"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: 3-D runs that cover each vector."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return e.select(
        F.lit("all").alias("pairing"), F.col("vec_id").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))).alias("run_id"), "v"
    ).select("pairing", "run_id", "t", F.slice(F.concat("v", "v"), F.col("run_id") * 3 + 1, 3).alias("e"))


def active_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each user's recording if it ended with the last event."""
    events = table(spark, sf_dir, "events").select("ts", "user_id")
    return events.groupBy(F.col("user_id").cast("string").alias("rec_id")).agg((F.max(_bin()) + 1).alias("n_samples"))


def exclusion_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hand-typed component list per user, made of its event counts and some noise."""
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("a"), F.count_if(F.col("event_type") == "view").alias("b")
    )
    return counts.select(
        F.col("user_id").cast("string").alias("rec_id"),
        F.concat((F.col("a") % 4).cast("string"), F.lit(", "), (F.col("b") % 4).cast("string"), F.lit(",x,-3, 0"), F.col("a").cast("string")).alias("listed"),
    )


def crowd_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hand-typed component list per crowd recording: that of its first user."""
    user = F.col("rec_id").cast("bigint")
    first = F.min(F.struct(user.alias("user"), "listed")).alias("first")
    return exclusion_texts(spark, sf_dir).groupBy(F.floor(user / GROUP).cast("string").alias("rec_id")).agg(first).select("rec_id", "first.listed")
