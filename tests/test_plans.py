import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsignal.operators import prepare, report
from pairsignal.plans import clean, train
from test_align import dyads, frame, meta
from test_prepare import wide
from test_signal import net, smooth_field


def recordings(seed, n=16, t=600):
    rng = np.random.default_rng(seed)
    return smooth_field(n, t, seed) + 0.05 * rng.standard_normal((n, t))


def test_clean_pairs_end_to_end(spark):
    a, b = recordings(1), recordings(2)
    a[3] = 0.0
    recs = {"a": a, "b": b}
    channels = net(spark, 16, "a")[0].unionByName(net(spark, 16, "b")[0]).withColumn(
        "ch", F.concat(F.lit("EEG "), F.col("ch_idx") + 1)
    )
    montage = net(spark, 16)[1]
    notes = spark.createDataFrame([("b", 2.0, 1.0, "cut")], "rec_id string, onset_s double, duration_s double, description string")
    excluded = spark.createDataFrame([("d0/a", [0]), ("d0/b", [])], "rec_id string, comps array<bigint>")
    cleaned, segments = clean.clean_pairs(
        frame(spark, recs), meta(spark, recs, 100.0), dyads(spark, ("a", "b")), channels, montage, notes, excluded=excluded, n_components=3, max_rounds=20
    )
    out = wide(cleaned.samples.collect())
    assert out["d0/a"].shape == out["d0/b"].shape == (500, 16)
    assert np.isfinite(out["d0/a"]).all() and np.abs(out["d0/a"][:, 3]).max() > 0
    assert [(s["kind"], s["start_t"], s["end_t"]) for s in segments.orderBy("start_t").collect()] == [("keep", 0, 200), ("cut", 200, 300), ("keep", 300, 600)]
    assert ("d0/a", 3, "flat") in {tuple(r) for r in cleaned.bad.select("rec_id", "ch_idx", "criterion").collect()}
    assert {r["ch"] for r in cleaned.channels.collect()} == {f"E{i + 1}" for i in range(16)}
    log = {r["original_file"]: r for r in cleaned.log.collect()}
    steps = [s["step"] for s in log["d0/a"]["steps"]]
    assert steps == ["load_data", "highpass_filter", "bad_channel_detection", "interpolate_bads", "ica_fit", "ica_apply"]
    assert log["d0/a"]["steps"][2]["params"]["flat"] == "3" and log["d0/a"]["steps"][5]["params"]["excluded_components"] == "0"
    back = report.from_json(report.as_json(cleaned.log, ["original_file"]), ["original_file"], "ts string, steps array<struct<step: string, params: map<string,string>>>")
    assert [s["step"] for s in back.filter("original_file = 'd0/b'").first()["steps"]] == steps


def test_supervised_and_time_only_scores(spark):
    rng = np.random.default_rng(3)
    recs = {"a": 3 + rng.standard_normal((2, 60)), "b": -3 + rng.standard_normal((2, 60))}
    pair, shapes = dyads(spark, ("a", "b")), meta(spark, recs)
    stacked = prepare.stack_wide(frame(spark, recs), pair)
    near, ends, labels = train.flat_inputs(stacked, pair, shapes)
    assert near.count() == 240 and tuple(ends.first()) == ("p0", 240, 192)
    scored = train.embed_and_score(near, ends, labels, runs=2, k=3)
    rows = scored.metrics.collect()
    assert {(r["run_id"], r["n_train"], r["n_val"]) for r in rows} == {(0, 192, 48), (1, 192, 48)}
    assert all(0 <= r["acc_val"] <= 1 and r["acc_train"] > 0.5 and r["cont_r2"] is None for r in rows)
    assert scored.variability.first()["mean_consistency"] > 0.5
    inputs, lengths = train.inputs(stacked, pair, shapes)
    traits = inputs.select("pairing", "t", F.get("x", F.lit(0)).alias("y"))
    plain = train.embed_and_score(inputs, lengths, traits=traits, runs=2).metrics.collect()
    assert all(r["acc_val"] is None and r["gof_bits"] is not None and r["cont_r2"] is not None for r in plain)


@pytest.mark.parametrize("most,rows_of_spaces", [(2048, [6]), (150, [2, 800])])
def test_short_pairings_are_scored_as_whole_chunks(spark, monkeypatch, most, rows_of_spaces):
    """A space of a short pairing is one row from the fit on, and has the scores, vectors and consistency of its rows."""
    monkeypatch.setattr(train, "WHOLE", most)
    rng = np.random.default_rng(4)
    recs = {n: base + rng.standard_normal((2, t)) for n, base, t in (("a", 1, 60), ("b", -1, 60), ("c", 0, 30), ("d", 1, 25), ("e", 0, 40))}
    recs["f"] = np.zeros((2, 40))
    pair, shapes = dyads(spark, ("a", "b"), ("c", "d"), ("e", "f")), meta(spark, recs)
    stacked = prepare.stack_wide(frame(spark, recs), pair)
    near, ends, labels = train.flat_inputs(stacked, pair, shapes)
    traits = near.select("pairing", "t", F.get("x", F.lit(0)).alias("y"))
    want = train.embed_and_score(near, ends, labels, traits, runs=2)
    counts, status = [], train.score.run_status
    monkeypatch.setattr(train.score, "run_status", lambda expected, embedded: counts.append(embedded.count()) or status(expected, embedded))
    parts, ends, labels = train.flat_inputs(stacked, pair, shapes, packed=True)
    got = train.embed_and_score(parts, ends, labels, traits, runs=2)
    assert counts == rows_of_spaces
    for a, b, keys in ((want.metrics, got.metrics, 3), (want.embedded, got.embedded, 3), (want.consistency, got.consistency, 4)):
        a, b = sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))
        assert len(a) == len(b) > 0
        for x, y in zip(a, b):
            assert x[:keys] == y[:keys]
            for v, w in zip(x[keys:], y[keys:]):
                assert (v is None) == (w is None) and (v is None or np.allclose(v, w, atol=1e-9))
    assert got.variability.count() == 3


def test_a_pairing_named_twice_is_scored_by_rows(spark):
    recs = {n: np.random.default_rng(i).standard_normal((2, 30)) for i, n in enumerate("abcd")}
    pair = dyads(spark, ("a", "b"), ("c", "d")).withColumn("pairing", F.lit("p"))
    parts, _, labels = train.flat_inputs(prepare.stack_wide(frame(spark, recs), pair), pair, meta(spark, recs), packed=True)
    assert parts.whole is None and parts.rows.count() == labels.count() > 0


def test_summary_fills_missing_metrics(spark):
    expected = spark.createDataFrame([("p", 0), ("p", 1)], "pairing string, run_id int")
    found = spark.createDataFrame([("p", 0, 0.75)], "pairing string, run_id int, acc_val double")
    summary = report.metrics_summary(expected, found, ["acc_val"], ["pairing", "run_id"])
    rows = {r["run_id"]: r["acc_val"] for r in summary.collect()}
    assert rows[0] == 0.75 and np.isnan(rows[1])
    assert tuple(report.pairing_report(summary, ["acc_val"]).first()) == ("p", 2, 0.75)
