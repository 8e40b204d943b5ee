"""Embedding and scoring of every pairing and run."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairsignal.functions.chunks import WHOLE, is_whole, of_split, pack, unpacked
from pairsignal.operators import embed, knn, prepare, score
from pairsignal.operators.blocks import attach_whole, row_count
from pairsignal.session import settle

SPACE = ["pairing", "run_id"]
PER_TASK = 100  # short pairings fitted in one task


class Parts(NamedTuple):
    """Inputs of short pairings as whole chunks, with their labels, and those of the other pairings as rows; None if none."""

    whole: DataFrame | None
    rows: DataFrame | None


class Scores(NamedTuple):
    embedded: DataFrame
    metrics: DataFrame
    consistency: DataFrame
    variability: DataFrame


def inputs(stacked: DataFrame, dyads: DataFrame, recordings: DataFrame,
           fraction: float = prepare.TRAIN_FRACTION) -> tuple[DataFrame, DataFrame]:
    """Stacked samples ``pairing, t, x`` and lengths ``pairing, n_samples, n_train``."""
    named = prepare.attach(stacked, dyads.select("dyad_id", "pairing"), "dyad_id", bound=dyads).select("pairing", "t", "x")
    short = prepare.common_lengths(dyads, recordings).join(dyads.select("dyad_id", "pairing"), "dyad_id")
    n = F.col("n_short")
    return named, settle(short.select("pairing", n.alias("n_samples"), F.floor(F.lit(float(fraction)) * n).cast("bigint").alias("n_train")))


def flat_inputs(stacked: DataFrame, dyads: DataFrame, recordings: DataFrame,
                packed: bool = False) -> tuple[DataFrame | Parts, DataFrame, DataFrame | None]:
    """One row per (time, channel) with its context window, lengths in such rows, and the role label of each row.

    With ``packed`` the first is ``Parts``, and the labels are those of its rows.
    """
    roles = prepare.channel_roles(dyads, recordings)
    _, lengths = inputs(stacked, dyads, recordings)
    named = dyads.select("dyad_id", "pairing")
    width = roles.groupBy("dyad_id").agg(F.count(F.lit(1)).alias("c"), F.count("y").alias("_known")).join(named, "dyad_id")
    flat = lengths.join(width, "pairing").select(
        "dyad_id", "pairing", "c", "_known", (F.col("n_samples") * F.col("c")).alias("n_samples"), (F.col("n_train") * F.col("c")).alias("n_train")
    )
    if packed:
        once = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c)) == 1
        short = (F.col("n_samples") <= WHOLE) & (F.col("_known") == F.col("c")) & once("dyad_id") & once("pairing")
        flat = flat.withColumn("_short", short)
    flat = settle(flat)
    ends = flat.select("pairing", "n_samples", "n_train")
    if not packed:
        near, labels = _flat_rows(stacked, roles, width, dyads)
        return near, ends, labels
    short, long = settle(flat.filter("_short")), settle(flat.filter("not _short"))
    whole = rows = labels = None
    if row_count(long):
        of = lambda some: prepare.attach(stacked, some.select("dyad_id").distinct(), "dyad_id", "left_semi", bound=some)
        rows, labels = _flat_rows(of(long), roles, width, dyads)
        stacked = of(short)
    if row_count(short) or rows is None:
        chunks = pack(stacked.withColumn("block", F.lit(0)), ["dyad_id"]).drop("block")
        sized = attach_whole(chunks, short.select("dyad_id", "pairing", "n_samples", "n_train"), "dyad_id", bound=dyads)
        marked = prepare.label_samples(sized, roles, dyads).drop("dyad_id")
        # So few bytes would be dealt over few tasks, but most of the work is what is done with them.
        dealt = marked.repartition(max(-(-row_count(short) // PER_TASK), 1), "pairing")
        whole = embed.receptive_field(dealt, "pairing", edges="replicate")
    return Parts(whole, rows), ends, labels


def _flat_rows(stacked: DataFrame, roles: DataFrame, width: DataFrame, dyads: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = prepare.attach(prepare.label_samples(stacked, roles, dyads), width, "dyad_id", bound=dyads).select(
        "pairing", (F.col("t") * F.col("c") + F.col("gch_idx")).alias("t"), F.array("x").alias("x"), F.col("y").cast("int").alias("label")
    )
    near = embed.receptive_field(rows.select("pairing", "t", "x"), "pairing", edges="replicate")
    return near, rows.select("pairing", "t", "label")


def embed_and_score(
    samples: DataFrame | Parts,
    lengths: DataFrame,
    labels: DataFrame | None = None,
    traits: DataFrame | None = None,
    runs: int = 5,
    k: int | str = knn.DEFAULT_K,
    scaling: str = "raw",
    fit_on: str = "train",
) -> Scores:
    """All pairings and runs in the same jobs.

    With ``labels`` (``pairing, t, label``) the fit uses them and a decoder is scored on them; without, the fit
    uses time alone and the decoding scores are NULL.  Whole chunks bring their labels.
    """
    parts = samples if isinstance(samples, Parts) else Parts(None, samples)
    found = [_scored(p, lengths, labels, traits, runs, k, scaling, fit_on) for p in parts if p is not None]
    embedded, metrics, consistency = (reduce(DataFrame.unionByName, same) for same in zip(*found))
    return Scores(embedded, metrics, consistency, score.variability(consistency, lengths))


def _with_split(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    return prepare.attach(rows, lengths.select("pairing", "n_train"), "pairing", bound=lengths).withColumn(
        "split", F.when(F.col("t") < F.col("n_train"), F.lit("train")).otherwise(F.lit("test"))
    ).drop("n_train")


def _scored(samples: DataFrame, lengths: DataFrame, labels: DataFrame | None, traits: DataFrame | None, runs: int, k: int | str,
            scaling: str, fit_on: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``embedded, metrics, consistency`` of rows or of whole chunks."""
    whole = is_whole(samples)
    labelled = "label" in samples.columns if whole else labels is not None
    fitted = samples if whole or labels is None else samples.join(labels.withColumnRenamed("label", "y"), ["pairing", "t"])
    embedded = settle(embed.embed_linear(fitted, lengths, "label" if labelled else "time", runs, fit_on))
    status = settle(score.run_status(lengths.select("pairing", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run_id")), embedded))
    good = score.successful_runs(embedded, status)
    rows = good if whole else _with_split(good, lengths)
    metrics = status.filter("ok").select(*SPACE).join(score.split_counts(rows, SPACE), SPACE)
    fit = score.infonce(good, lengths).select(*SPACE, F.col("bits").alias("gof_bits"))
    metrics = metrics.join(fit, SPACE, "left")
    if not labelled:
        metrics = metrics.withColumns({c: F.lit(None).cast("double") for c in ("acc_train", "acc_val", "r2")})
    else:
        if whole:
            decoded = settle(knn.decode(rows, rows, k))
        else:
            known = settle(rows.join(labels, ["pairing", "t"]))
            voted = knn.decode(known.filter("split = 'train'"), known, k).withColumnRenamed("qid", "t")
            decoded = settle(known.drop("e").join(voted, [*SPACE, "t"]))
        part = lambda split: of_split(decoded, split, ["label", "pred"])
        for name, split in (("acc_train", "train"), ("acc_val", "test")):
            scored = score.accuracy(part(split), SPACE)
            metrics = metrics.join(scored.select(*SPACE, F.col("accuracy").alias(name)), SPACE, "left")
        metrics = metrics.join(score.r_squared(part("test"), SPACE, "label", "pred").select(*SPACE, "r2"), SPACE, "left")
    if whole:
        embedded, good = (unpacked(x, SPACE, "es", "e") for x in (embedded, good))
    if whole and traits is not None:
        rows = _with_split(good, lengths)
    metrics = metrics.join(score.decode_continuous(rows, traits), SPACE, "left").select(
        "pairing", F.lit(scaling).alias("scaling"), "run_id", "n_train", "n_val", "gof_bits", "acc_train", "acc_val", "r2", "cont_r2"
    )
    return embedded, metrics, score.run_consistency(good)  # consistency is worked out only if it is read
