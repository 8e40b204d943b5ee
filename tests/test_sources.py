import os

import numpy as np
from pyspark.sql import functions as F

from pairsignal.sources import edf, edf_source, montage, npy, tables


def _field(values, width):
    return b"".join(str(v).encode("latin-1").ljust(width) for v in values)


def write_edf(path, digital, labels, rate, notes=None, unit="uV", phys=(-3200, 3200), dig=(-32768, 32767), more_notes=None):
    """A small file: ``digital`` is (channels, samples), one record per second; ``more_notes`` has a signal of its own."""
    noted = [n for n in (notes, more_notes) if n is not None]
    n_ch, n = digital.shape
    records = n // rate
    width = 60
    names = list(labels) + ["EDF Annotations"] * len(noted)
    counts = [rate] * n_ch + [width] * len(noted)
    k = len(names)
    head = b"".join([
        b"0".ljust(8), b"S1".ljust(80), b"R".ljust(80), b"01.01.24", b"00.00.00", str(256 * (k + 1)).encode().ljust(8),
        b"EDF+C".ljust(44), str(records).encode().ljust(8), b"1".ljust(8), str(k).encode().ljust(4),
    ])
    head += _field(names, 16) + _field([""] * k, 80) + _field([unit] * k, 8) + _field([phys[0]] * k, 8) + _field([phys[1]] * k, 8)
    head += _field([dig[0]] * k, 8) + _field([dig[1]] * k, 8) + _field([""] * k, 80) + _field(counts, 8) + _field([""] * k, 32)
    with open(path, "wb") as f:
        f.write(head)
        for r in range(records):
            f.write(digital[:, r * rate : (r + 1) * rate].astype("<i2").tobytes())
            for own in noted:
                text = f"+{r}\x14\x14\x00".encode() + b"".join(
                    f"+{on}\x15{dur}\x14{what}\x14\x00".encode() for on, dur, what in own if int(on) == r
                )
                f.write(text.ljust(2 * width, b"\x00"))


def test_edf_round_trip_in_many_ranges(spark, folder):
    rng = np.random.default_rng(1)
    data = {name: rng.integers(-3000, 3000, (3, 50 * 7)) for name in ("nt1_speak", "nt2_listen")}
    for name, digital in data.items():
        write_edf(os.path.join(folder, f"{name}.edf"), digital, ["EEG 1", "EEG VREF", "STATUS"], 50, [(2.5, 1.25, "cut"), (4, 0.5, "EMG")])
    headers = edf.read_headers(spark, folder)
    recs = {r["rec_id"]: r for r in edf.recordings(headers).collect()}
    assert recs["nt1_speak"]["sfreq"] == 50.0 and recs["nt1_speak"]["n_samples"] == 350 and recs["nt1_speak"]["subject"] == "S1"
    chs = edf.channels(headers).filter("rec_id = 'nt2_listen'").orderBy("ch_idx").collect()
    assert [(c["ch"], c["type"]) for c in chs] == [("EEG 1", "eeg"), ("EEG VREF", "eeg"), ("STATUS", "stim")]
    gain = 6400 / 65535
    for size in (1, 1 << 20):
        rows = edf.samples(headers, size).collect()
        assert len(rows) == 700
        for name, digital in data.items():
            mine = sorted((r for r in rows if r["rec_id"] == name), key=lambda r: r["t"])
            assert [r["t"] for r in mine] == list(range(350))
            want = ((digital + 32768) * gain - 3200).T * 1e-6
            assert np.allclose([r["x"] for r in mine], want, atol=1e-12)
    notes = sorted((r["onset_s"], r["duration_s"], r["description"]) for r in edf.annotations(headers).filter("rec_id = 'nt1_speak'").collect())
    assert notes == [(2.5, 1.25, "cut"), (4.0, 0.5, "EMG")]


def test_edf_as_a_format(spark, folder):
    """The data source gives what the range reader gives, whatever is asked for, and reads only the records asked for."""
    rng = np.random.default_rng(2)
    for name in ("one", "two"):
        write_edf(os.path.join(folder, f"{name}.edf"), rng.integers(-3000, 3000, (3, 90)), ["E1", "E2", "STATUS"], 10, [(1, 0.5, "a")])
    edf_source.register(spark)
    want = {(r.rec_id, r.t): r.x for r in edf.samples(edf.read_headers(spark, folder)).collect()}
    for size in (100, 1 << 20):
        rows = spark.read.format("edf").option("rangeBytes", size).load(folder)
        assert {(r.rec_id, r.t): r.x for r in rows.collect()} == want and rows.count() == 180
        part = rows.filter("rec_id = 'two' and t >= 25 and t < 41")
        assert {(r.rec_id, r.t): r.x for r in part.collect()} == {k: v for k, v in want.items() if k[0] == "two" and 25 <= k[1] < 41}
        assert rows.filter("t = 7 and x[0] > -1").count() == 2 and rows.filter("rec_id in ('one', 'none')").count() == 90
        assert rows.filter("rec_id = 'none'").count() == 0 and rows.filter("t > 5 and t < 3").count() == 0
    named = spark.read.format("edf").option("channels", "STATUS, E1").load(os.path.join(folder, "one.edf"))
    assert {r.t: r.x for r in named.collect()} == {t: [v[2], v[0]] for (n, t), v in want.items() if n == "one"}
    path = os.path.join(folder, "two.edf")
    header = edf.describe("file:" + path, "two", os.path.getsize(path))
    reader = edf_source.EdfReader({"path": folder, "rangeBytes": "100"})
    stretches = [p for p in reader.partitions() if p.rec_id == "two"]
    read = [edf_source.wanted_records(header, p.begin, p.end, 25, 40) for p in stretches]
    assert sorted(r for a, b in read for r in range(a, b)) == [2, 3, 4]
    every = [edf_source.wanted_records(header, p.begin, p.end, 0, edf_source.NO_END) for p in stretches]
    assert sorted(r for a, b in every for r in range(a, b)) == list(range(9))


def test_edf_with_two_annotation_signals(spark, folder):
    write_edf(os.path.join(folder, "a.edf"), np.zeros((1, 40), int), ["E1"], 10, [(1, 0.5, "first")], more_notes=[(2.5, 1.0, "second"), (3, 0.0, "third")])
    headers = edf.read_headers(spark, folder)
    found = sorted((r["onset_s"], r["description"]) for r in edf.annotations(headers, 1).collect())
    assert found == [(1.0, "first"), (2.5, "second"), (3.0, "third")] and edf.samples(headers).count() == 40


def test_npy_is_read_by_time_whatever_its_proportions(spark, folder):
    wide, tall = np.arange(3 * 11, dtype=np.float32).reshape(3, 11), np.asfortranarray(np.arange(20.0).reshape(5, 4))
    np.save(os.path.join(folder, "wide.npy"), wide)
    np.save(os.path.join(folder, "tall.npy"), tall)
    for size in (24, 1 << 20):
        rows = npy.samples(npy.read_headers(spark, folder), size).collect()
        for name, array in (("wide", wide), ("tall", tall)):
            mine = sorted((r for r in rows if r["rec_id"] == name), key=lambda r: r["t"])
            assert np.array_equal(np.array([r["x"] for r in mine]), array.T)


def test_montage_lines(spark, folder):
    path = os.path.join(folder, "net.sfp")
    with open(path, "w") as f:
        f.write("FidNz 0 9.0 -2.0\nE1\t1.5 2.5   -3\n\nnot a position\nCz 0 0 1e1\n")
    rows = {r["ch"]: (r["px"], r["py"], r["pz"]) for r in montage.read_montage(spark, path).collect()}
    assert rows == {"FidNz": (0.0, 9.0, -2.0), "E1": (1.5, 2.5, -3.0), "Cz": (0.0, 0.0, 10.0)}


def test_grid_is_discovered_and_only_given_cells_are_replaced(spark, folder):
    def cell(clean, pairing, value, n):
        return spark.range(n).select(
            F.lit(clean).alias("clean"), F.lit("raw").alias("scaling"), F.lit(pairing).alias("pairing"), F.col("id").alias("t"),
            F.array(F.lit(float(value)), F.lit(0.0)).alias("x"),
        )

    path = os.path.join(folder, "grid")
    tables.write_grid(cell("cut_60", "spk1-lst2", 1, 5).unionByName(cell("zeropad_30", "spk1-lst2", 2, 7)), path, block=2)
    tables.write_grid(cell("cut_60", "spk1-lst2", 3, 4), path)
    found = tables.discover_cells(spark, path)
    assert [tuple(r) for r in found.collect()] == [("cut_60", "raw", "spk1-lst2"), ("zeropad_30", "raw", "spk1-lst2")]
    shapes = {r["clean"]: (r["n_samples"], r["n_channels"]) for r in tables.shape_report(tables.read_grid(spark, path)).collect()}
    assert shapes == {"cut_60": (4, 2), "zeropad_30": (7, 2)}
    expected = spark.createDataFrame([("cut_60", "raw", "spk1-lst2"), ("cut_60", "raw", "lst1-spk2")], "clean string, scaling string, pairing string")
    assert [r["pairing"] for r in tables.missing_cells(expected, found).collect()] == ["lst1-spk2"]


def test_text_sinks(spark, folder):
    rows = spark.createDataFrame([("p", 1, 0.5)], "pairing string, run_id int, r2 double")
    path = os.path.join(folder, "metrics")
    tables.write_csv(rows, path, "overwrite")
    tables.write_csv(rows.withColumn("run_id", F.lit(2)), path)
    assert tables.read_csv(spark, path, "pairing string, run_id int, r2 double").count() == 2
    tables.write_json(rows, os.path.join(folder, "j"))
    back = tables.read_json(spark, os.path.join(folder, "j"), "pairing string, r2 double, train_accuracy double").first()
    assert back["r2"] == 0.5 and back["train_accuracy"] is None
    tables.write_lines(spark.createDataFrame([("a line",)], "value string"), os.path.join(folder, "lines"), "overwrite")
    assert spark.read.text(os.path.join(folder, "lines")).first()[0] == "a line"
    tables.write_samples(spark.createDataFrame([("r", 0, [1.0])], "rec_id string, t bigint, x array<double>"), os.path.join(folder, "s"))
    assert spark.read.parquet(os.path.join(folder, "s")).count() == 1
