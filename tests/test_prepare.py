import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsignal.operators import blocks, prepare
from test_align import dyads, frame, meta


def wide(rows, key="rec_id"):
    found = {}
    for r in sorted(rows, key=lambda r: r["t"]):
        found.setdefault(r[key], []).append(r["x"])
    return {k: np.array(v) for k, v in found.items()}


def test_stack_and_scale(spark):
    rng = np.random.default_rng(0)
    recs = {"a": rng.standard_normal((2, 7)), "b": rng.standard_normal((3, 5))}
    recs["b"][1] = 4.0
    pair = dyads(spark, ("a", "b"))
    stacked = prepare.stack_wide(frame(spark, recs), pair)
    both = np.vstack([recs["a"][:, :5], recs["b"]])
    assert np.allclose(wide(stacked.collect(), "dyad_id")["d0"], both.T)
    scaled = wide(prepare.minmax_wide(stacked, ["dyad_id"], pair).collect(), "dyad_id")["d0"].T
    span = np.where(np.ptp(both, axis=1) == 0, 1, np.ptp(both, axis=1))[:, None]
    assert np.allclose(scaled, (both - both.min(axis=1, keepdims=True)) / span)
    assert scaled.min() >= 0 and scaled.max() <= 1 and (scaled[3] == 0).all()


def test_long_form_agrees_with_wide_form(spark):
    rng = np.random.default_rng(1)
    recs = {"a": rng.standard_normal((2, 4)), "b": rng.standard_normal((2, 6))}
    pair, shapes = dyads(spark, ("a", "b")), meta(spark, recs)
    long = prepare.to_long(frame(spark, recs)).withColumn("ch", F.concat(F.lit("c"), "ch_idx"))
    stacked = prepare.stack_long(prepare.align_lengths(long, pair, shapes), pair, shapes)
    rows = {(r["t"], r["gch_idx"]): r["x"] for r in prepare.minmax_long(stacked, pair).collect()}
    whole = wide(prepare.minmax_wide(prepare.stack_wide(frame(spark, recs), pair), ["dyad_id"], pair).collect(), "dyad_id")["d0"]
    assert rows == {(t, c): pytest.approx(whole[t, c]) for t in range(4) for c in range(4)}


def test_nan_spreads_over_its_channel_only(spark):
    recs = {"a": np.array([[1.0, np.nan, 3.0], [1.0, 2.0, 3.0]]), "b": np.ones((1, 3))}
    pair = dyads(spark, ("a", "b"))
    out = wide(prepare.minmax_wide(prepare.stack_wide(frame(spark, recs), pair), ["dyad_id"], pair).collect(), "dyad_id")["d0"]
    assert np.isnan(out[:, 0]).all() and np.allclose(out[:, 1], [0, 0.5, 1])


def test_grid_has_every_cell_in_both_scalings(spark):
    recs = {"a": np.arange(6.0).reshape(2, 3), "b": np.arange(6.0, 12).reshape(2, 3)}
    cells = spark.createDataFrame([("cut_60", "spk1-lst2", "a", "b"), ("cut_60", "lst1-spk2", "b", "a")], "clean string, pairing string, rec_a string, rec_b string")
    rows = prepare.prepare_grid(frame(spark, recs).withColumn("clean", F.lit("cut_60")), cells).collect()
    assert {(r["scaling"], r["pairing"]) for r in rows} == {(s, p) for s in ("raw", "normalized") for p in ("spk1-lst2", "lst1-spk2")}
    assert len(rows) == 12
    raw = wide([r for r in rows if r["scaling"] == "raw" and r["pairing"] == "lst1-spk2"], "pairing")["lst1-spk2"]
    assert np.array_equal(raw, np.vstack([recs["b"], recs["a"]]).T)


def test_time_stack_then_slice_is_identity(spark):
    rng = np.random.default_rng(2)
    recs = {"a": rng.standard_normal((2, 4)), "b": rng.standard_normal((2, 3))}
    shapes = meta(spark, recs)
    names = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x", "y"])], "rec_id string, names array<string>")
    pairs = spark.createDataFrame([("ab", "a", "b")], "out_id string, rec_1 string, rec_2 string")
    out = wide(prepare.stack_in_time(frame(spark, recs), pairs, names, shapes).collect())["ab"]
    assert np.array_equal(out, np.hstack([recs["a"], recs["b"]]).T)
    other = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y", "x"])], "rec_id string, names array<string>")
    with pytest.raises(Exception, match="channel names or order differ in ab"):
        prepare.stack_in_time(frame(spark, recs), pairs, other, shapes).collect()


def test_trim_split_and_sixths(spark):
    recs = {"a": np.arange(41.0)[None], "b": np.arange(5.0)[None]}
    samples, shapes = frame(spark, recs), meta(spark, recs)
    trimmed = wide(prepare.middle_trim(samples, shapes, F.lit(10)).collect())
    assert trimmed["a"].ravel().tolist() == list(range(15, 25)) and trimmed["b"].ravel().tolist() == list(range(5))
    split = prepare.time_split(samples, shapes).filter("split = 'train'").groupBy("rec_id").count().collect()
    assert {r["rec_id"]: r["count"] for r in split} == {"a": int(0.8 * 41), "b": 4}
    part = sorted((r["t"], r["part"]) for r in prepare.sixths(samples, shapes).filter("rec_id = 'a'").collect())
    sixth = int(0.8 * 41) // 6
    assert part == [(t, 1) for t in range(sixth, 2 * sixth)] + [(t, 3) for t in range(3 * sixth, 4 * sixth)]


def test_flatten_and_labels(spark):
    recs = {"a": np.arange(4.0).reshape(2, 2), "b": np.arange(4.0, 6).reshape(1, 2)}
    pair, shapes = dyads(spark, ("a", "b")), meta(spark, recs)
    stacked = prepare.stack_wide(frame(spark, recs), pair)
    flat = sorted((r["row"], r["x"]) for r in prepare.flatten(stacked).collect())
    whole = np.vstack([recs["a"], recs["b"]])
    assert flat == list(enumerate(whole.T.reshape(-1)))
    roles = prepare.channel_roles(pair, shapes)
    labelled = sorted((r["t"], r["gch_idx"], r["x"], r["role"], r["y"]) for r in prepare.label_samples(stacked, roles, pair).collect())
    assert labelled == [(t, c, whole[c, t], "speaker" if c < 2 else "listener", int(c < 2)) for t in range(2) for c in range(3)]
    other = prepare.channel_roles(pair, shapes, {"speaker": 0, "listener": 1})
    assert sorted((r["gch_idx"], r["y"]) for r in other.collect()) == [(0, 0), (1, 0), (2, 1)]


@pytest.mark.parametrize("block", [1, 3, 50])
def test_running_sums_and_row_numbers_do_not_depend_on_blocks(spark, block):
    rng = np.random.default_rng(4)
    rows = [(k, int(t), int(rng.integers(-3, 4))) for k in ("hot", "cold") for t in range(40 if k == "hot" else 3)]
    df = spark.createDataFrame(rows, "k string, t bigint, v bigint").withColumn("block", blocks.block_of("t", block))
    got = sorted((r["k"], r["t"], r["s"]) for r in blocks.running_sums(df, ["k"], {"s": F.col("v")}).collect())
    want = [(k, t, sum(v for kk, tt, v in rows if kk == k and tt <= t)) for k, t, _ in rows]
    assert got == sorted(want)
    numbered = blocks.number_rows(df.select("k", F.col("t").alias("u")), ["k"], ["u"], blocks.block_of("u", block)).collect()
    assert all(r["t"] == r["u"] for r in numbered)


def test_metadata_too_large_to_broadcast_joins_the_same(spark, monkeypatch):
    recs = {"a": np.ones((1, 50)), "b": np.zeros((1, 3))}
    rows, shapes = frame(spark, recs), meta(spark, recs)
    small = sorted(map(str, blocks.attach(rows, shapes, "rec_id").collect()))
    monkeypatch.setattr(blocks, "SMALL_NUMBERS", 1)
    salted = blocks.attach(rows, shapes, "rec_id").select(blocks.attach(rows, shapes, "rec_id").columns)
    assert "Broadcast" not in salted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, salted.collect())) == small


def test_metadata_of_small_files_is_not_broadcast_beyond_the_limit(spark, monkeypatch):
    recs = {"a": np.ones((1, 50)), "b": np.zeros((1, 3))}
    rows, shapes = frame(spark, recs), blocks.settle(meta(spark, recs))
    small = sorted(map(str, blocks.attach(rows, shapes, "rec_id").collect()))
    monkeypatch.setattr(blocks, "SMALL_NUMBERS", 1)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for heavy, salted in ((0, True), (49, True), (50, False)):
        for how in ("inner", "left"):
            joined = blocks.attach(rows, shapes, "rec_id", how, **({"heavy": heavy} if heavy else {}))
            assert "BroadcastHashJoin" not in plan(joined) and ("_salt" in plan(joined)) == salted
            assert sorted(map(str, joined.collect())) == small


def test_heavy_keys_are_split(spark, monkeypatch):
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(90)], "k string, i bigint")
    meta = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("none", 4)], "k string, v bigint")
    plain = sorted(map(tuple, blocks.spread_join(rows, meta, ["k"], "i").select("k", "i", "v").collect()))
    monkeypatch.setattr(blocks, "HEAVY_ROWS", 7)
    split = blocks.spread_join(rows, meta, ["k"], "i")
    assert sorted(map(tuple, split.select("k", "i", "v").collect())) == plain and len(plain) == 2 * 60 + 1
