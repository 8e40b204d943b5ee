import pytest
from pyspark.sql import functions as F

from pairsignal import schemas
from pairsignal.functions import text
from pairsignal.operators import channels

NAMES = ["EEG 1", "EEG 01", "eeg VREF", "EEG VREF", "EEG x", "EEG  5", "eeg 7", "EEG 1_0", "EEG +3", "E7", "Cz", "EEG 12 extra"]


def table(spark, names, rec="r"):
    return spark.createDataFrame([(rec, i, n) for i, n in enumerate(names)], "rec_id string, ch_idx int, ch string")


def test_rename_rules(spark):
    rows = channels.rename_channels(table(spark, NAMES)).orderBy("ch_idx").collect()
    assert [r["ch"] for r in rows] == ["E1", "E1", "Cz", "Cz", "EEG x", "EEG  5", "eeg 7", "E10", "E3", "E7", "Cz", "E12"]
    assert [r["old"] for r in channels.rename_channels(table(spark, NAMES).withColumn("old", F.col("ch"))).filter("skipped").orderBy("ch_idx").collect()] == ["EEG x", "EEG  5"]


def test_rename_is_idempotent(spark):
    once = channels.rename_channels(table(spark, NAMES)).drop("skipped")
    assert once.collect() == channels.rename_channels(once).drop("skipped").collect()


def test_duplicates_are_found_and_refused(spark):
    renamed = channels.rename_channels(table(spark, ["EEG 1", "EEG 01", "EEG 2"])).drop("skipped")
    assert [tuple(r) for r in channels.duplicate_channels(renamed).collect()] == [("r", "E1", 2)]
    with pytest.raises(Exception, match="duplicate channel E1 in r"):
        channels.require_unique_channels(renamed).collect()
    fine = table(spark, ["EEG 1", "EEG 2"])
    assert sorted(map(tuple, channels.require_unique_channels(fine).collect())) == sorted(map(tuple, fine.collect()))


def test_pick_channels_keeps_order(spark):
    chs = spark.createDataFrame([("r", 0, "a", "eeg"), ("r", 1, "b", "stim"), ("r", 2, "c", "eeg")], "rec_id string, ch_idx int, ch string, type string")
    rows = spark.createDataFrame([("r", 0, [1.0, 2.0, 3.0])], "rec_id string, t bigint, x array<double>")
    assert channels.pick_channels(rows, chs, chs).first()["x"] == [1.0, 3.0]


def test_rates_of_a_dyad_must_agree(spark):
    dyads = spark.createDataFrame([("d", "p", "a", "speaker", "b", "listener")], "dyad_id string, pairing string, rec_a string, role_a string, rec_b string, role_b string")
    recs = spark.createDataFrame([("a", 250.0), ("b", 500.0)], "rec_id string, sfreq double")
    with pytest.raises(Exception, match="sampling rates differ in d"):
        channels.require_equal_sfreq(dyads, recs).collect()
    assert channels.require_equal_sfreq(dyads, recs.withColumn("sfreq", F.lit(250.0))).first()["sfreq"] == 250.0


def test_layouts_are_checked(spark):
    rows = spark.createDataFrame([("r", 1, [1.0], "x")], "rec_id string, t bigint, x array<double>, more string")
    assert schemas.conform(rows, schemas.SAMPLES_WIDE).columns == ["rec_id", "t", "x"]
    with pytest.raises(ValueError, match="column t is missing"):
        schemas.conform(rows.drop("t"), schemas.SAMPLES_WIDE)
    with pytest.raises(ValueError, match="column t is int, expected bigint"):
        schemas.conform(rows.withColumn("t", F.col("t").cast("int")), schemas.SAMPLES_WIDE)


def test_text_functions(spark):
    row = spark.range(1).select(
        text.exclusion_list(F.lit("1, 2,x,-3, 07")).alias("ex"),
        text.exclusion_list(F.lit("")).alias("none"),
        text.stem(F.lit("file:/a/b.c/nt9_speak.v2.edf")).alias("stem"),
        text.stem(F.lit("/a/.hidden")).alias("hidden"),
        text.cleaned_name(F.lit("x/nt9.set")).alias("cleaned"),
        text.pairing_part(F.lit("lst9-spk10"), "a", "role").alias("ra"),
        text.pairing_part(F.lit("lst9-spk10"), "b", "subject").alias("sb"),
        text.pairing_part(F.lit("stacked"), "b", "subject").alias("nosubj"),
        text.result_line(F.lit("cut_60/raw/spk9-lst10"), F.lit(0.91237), F.lit(0.08763)).alias("line"),
    ).first()
    assert row["ex"] == [1, 2, 7] and row["none"] == []
    assert row["stem"] == "nt9_speak.v2" and row["hidden"] == ".hidden" and row["cleaned"] == "nt9_preprocessed"
    assert row["ra"] == "listener" and row["sb"] == 10 and row["nosubj"] is None
    assert row["line"] == "cut_60/raw/spk9-lst10".ljust(40) + "  consistency=0.9124  variability=0.0876"


def test_pick_recordings_numbers_the_channels_anew(spark):
    samples = spark.createDataFrame([("a", t, [1.0, 9.0, 2.0]) for t in range(3)] + [("b", 0, [9.0])], "rec_id string, t long, x array<double>")
    table = spark.createDataFrame([("a", 0, "E1", "eeg"), ("a", 1, "STATUS", "stim"), ("a", 2, "E2", "eeg"), ("b", 0, "STATUS", "stim")], "rec_id string, ch_idx int, ch string, type string")
    shapes = spark.createDataFrame([("a", 1.0, 3, 3), ("b", 1.0, 1, 1)], "rec_id string, sfreq double, n_channels int, n_samples long")
    picked, kept, recordings = channels.pick_recordings(samples, table, shapes)
    assert [(r.rec_id, r.x) for r in picked.collect()] == [("a", [1.0, 2.0])] * 3
    assert sorted((r.ch_idx, r.ch) for r in kept.collect()) == [(0, "E1"), (1, "E2")]
    assert [(r.rec_id, r.n_channels, r.n_samples) for r in recordings.collect()] == [("a", 2, 3)]
