"""Fits and scores with labels, synchrony, group comparison, saved lists and sinks against numpy."""

import os

import numpy as np
import pytest

from pairsignal.functions.vectors import half
from pairsignal.operators import compare, embed, score, synchrony
from pairsignal.sources import npy, tables


def rows_of(spark, x, y):
    table = spark.createDataFrame([("p", t, [float(v) for v in x[t]], float(y[t])) for t in range(len(x))], "pairing string, t long, x array<double>, y double")
    return table, spark.createDataFrame([("p", len(x), len(x))], "pairing string, n_samples long, n_train long")


def weights(n, run):
    return -np.log1p(-embed._mix(np.arange(n), run))


def solved(w, x, wanted, d):
    mean = w @ x / w.sum()
    total = (x * w[:, None]).T @ x / w.sum() - np.outer(mean, mean)
    return embed._directions(total, wanted, d), mean


@pytest.mark.parametrize("constant", [False, True])
def test_fit_by_label_difference(spark, constant):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 5))
    y = np.zeros(300) if constant else np.round(np.cumsum(draw.normal(size=300)), 2)
    table, ends = rows_of(spark, x, y)
    got = {(r.run_id, r.out_idx): r for r in embed.fit_linear(table, ends, "delta", 2, offset=3, dimensions=2, block=64).collect()}
    steps = 300 - 3
    drawn = (np.arange(300) % embed.DRAW_MODULUS) * embed.DRAW_FACTOR % steps
    target = y + (y[drawn + 3] - y[drawn])
    partner = [min(range(300), key=lambda j: (abs(y[j] - v), y[j], j)) for v in target]
    for run in range(2):
        w = weights(300, run)
        a, b = w @ x / w.sum(), w @ x[partner] / w.sum()
        wanted = (x * w[:, None]).T @ x[partner] / w.sum() - np.outer(a, b)
        directions, mean = solved(w, x, wanted, 2)
        for k in range(2):
            assert np.allclose(got[run, k].w, directions[k], atol=1e-8) and np.isclose(got[run, k].b, -directions[k] @ mean)
    made = embed.embed_linear(table, ends, "delta", 1, "all", offset=3, dimensions=2)
    assert made.count() == 300


def test_fit_by_label_sums_the_pairs_of_each_label(spark):
    draw = np.random.default_rng(5)
    x, y = draw.normal(size=(200, 4)), draw.integers(0, 7, 200) / 4
    table, ends = rows_of(spark, x, y)
    got = {r.out_idx: r for r in embed.fit_linear(table, ends, "label", 1, dimensions=2, block=64).collect()}
    w = weights(200, 0)
    mean = w @ x / w.sum()
    wanted = np.zeros((4, 4))
    for label in np.unique(y):
        own = w[y == label]
        off = own @ x[y == label] / own.sum() - mean
        wanted += own.sum() / w.sum() * np.outer(off, off)
    directions, _ = solved(w, x, wanted, 2)
    assert all(np.allclose(got[k].w, directions[k], atol=1e-8) for k in range(2))


def brute_labelled(e, y, batch_of, temperature):
    e = e / np.linalg.norm(e, axis=1, keepdims=True)
    losses, fits = [], []
    for b in set(batch_of):
        own = [t for t in range(len(e)) if batch_of[t] == b and not np.isnan(y[t])]
        for k, t in enumerate(own):
            others = own[k + 1:] + own[:k]
            if others:
                pos = min(others, key=lambda u: abs(y[u] - y[t]))  # the first of the nearest ones, in order from t on
                far = np.log(sum(np.exp(e[t] @ e[u] / temperature) for u in others))
                losses.append(far - e[t] @ e[pos] / temperature)
                fits.append((np.log(len(others)) - losses[-1]) / np.log(2))
    return np.mean(losses), np.mean(fits)


def test_labelled_goodness_of_fit(spark):
    draw = np.random.default_rng(6)
    e, y = draw.normal(size=(90, 3)), draw.integers(0, 5, 90).astype(float)
    y[7] = np.nan
    table = spark.createDataFrame([("p", 0, t, e[t].tolist(), None if np.isnan(y[t]) else float(y[t])) for t in range(90)], "pairing string, run_id int, t long, e array<double>, y double")
    ends = spark.createDataFrame([("p", 90)], "pairing string, n_samples long")
    got = score.infonce_labelled(table, ends, batch=16).first()
    batches = [(t * score.LABEL_FACTOR) % score.LABEL_MODULUS % (90 // 16) for t in range(90)]
    loss, bits = brute_labelled(e, y, batches, score.TEMPERATURE)
    assert got.n == 89 and np.isclose(got.loss, loss) and np.isclose(got.bits, bits)


def test_a_reference_alone_is_counted(spark):
    one = spark.createDataFrame([("p", 0, 0, [1.0, 0.0], 1.0)], "pairing string, run_id int, t long, e array<double>, y double")
    ends = spark.createDataFrame([("p", 1)], "pairing string, n_samples long")
    got = score.infonce_labelled(one, ends).first()
    assert got.n == 1 and got.loss is None and got.bits is None
    pair = spark.createDataFrame([("p", 0, t, [1.0, float(t)]) for t in range(3)], "pairing string, run_id int, t long, e array<double>")
    got = score.infonce(pair, spark.createDataFrame([("p", 3)], "pairing string, n_samples long"), batch=512, offset=2).first()
    assert got.n == 1 and got.loss is None


def test_synchrony(spark):
    draw = np.random.default_rng(8)
    a, b = draw.normal(size=(50, 3)), draw.normal(size=(50, 2))
    a[10:20, 1] = 4.0  # flat in one window
    rows = [("a", t, a[t].tolist()) for t in range(50)] + [("b", t, b[t].tolist()) for t in range(50) if t not in (5, 33)]
    samples = spark.createDataFrame(rows, "rec_id string, t long, x array<double>")
    dyads = spark.createDataFrame([("d", "a", "speaker", "b", "listener"), ("e", "a", "speaker", "none", "listener")], "dyad_id string, rec_a string, role_a string, rec_b string, role_b string")
    found = synchrony.window_synchrony(samples, dyads, 10, 2)
    got = {(r.win, r.lag, r.ch_idx): (r.n, r.r) for r in found.filter("dyad_id = 'd'").collect()}
    assert len(got) == 5 * 5 * 2
    for (win, lag, c), (n, r) in got.items():
        times = [t for t in range(win * 10, win * 10 + 10) if 0 <= t + lag < 50 and t + lag not in (5, 33)]
        x, y = a[times, c], b[[t + lag for t in times], c]
        assert n == len(times) and (r is None if np.ptp(x) == 0 else np.isclose(r, np.corrcoef(x, y)[0, 1]))
    assert all(r.n == 0 and r.r is None for r in found.filter("dyad_id = 'e'").collect())
    led = {r.leader: r for r in synchrony.synchrony_by_leader(found.filter("dyad_id = 'd'"), dyads).collect()}
    ahead = [r for (_, lag, _), (_, r) in got.items() if lag > 0 and r is not None]
    assert led["speaker"].n == len(ahead) and np.isclose(led["speaker"].r, np.mean(ahead)) and set(led) == {"speaker", "listener", "none"}


def test_group_comparison(spark):
    draw = np.random.default_rng(9)
    values = [int(v) for v in draw.normal(1000, 50, 60)]
    units = [(u, "a" if u % 3 == 0 else "b", values[u] + (60 if u % 3 == 0 else 0)) for u in range(60)]
    table = spark.createDataFrame(units + [(99, None, 5), (98, "a", None)], "unit long, grp string, value long")
    got = compare.group_comparison(table, "a", relabellings=50).first()
    def difference(labels):
        first, rest = [v for (_, _, v), i in zip(units, labels) if i], [v for (_, _, v), i in zip(units, labels) if not i]
        return sum(first) / len(first) - sum(rest) / len(rest)
    real = difference([g == "a" for _, g, _ in units])
    drawn = [real]
    for p in range(1, 51):
        drawn.append(difference([((u * compare.FACTOR + p * compare.STEP) % compare.MODULUS) * compare.FACTOR % compare.MODULUS * 60 < 20 * compare.MODULUS for u, _, _ in units]))
    assert (got.n_first, got.n_rest) == (20, 40) and np.isclose(got.difference, real) and np.isclose(got.p, np.mean(np.abs(drawn) >= abs(real))) and got.p < 0.1
    alone = compare.group_comparison(table.filter("grp = 'a'"), "a", relabellings=5).first()
    assert alone.n_rest == 0 and alone.difference is None and alone.p is None
    assert compare.group_comparison(table.limit(0), "a", relabellings=5).first().difference is None


def test_rollup(spark):
    rows = [("g", "p", 0, 1.0), ("g", "p", 1, 3.0), ("g", "q", 0, None), ("h", "r", 0, 5.0)]
    table = spark.createDataFrame(rows, "grp string, pairing string, run_id int, value double")
    got = {(r.grp, r.pairing, r.run_id): (r.level, r.n, r["mean"]) for r in compare.metrics_rollup(table, ["grp", "pairing", "run_id"], "value").collect()}
    assert got[None, None, None] == (0, 3, 3.0) and got["g", None, None] == (1, 2, 2.0) and got["g", "p", None] == (2, 2, 2.0) and got["g", "q", 0] == (3, 0, None)


def test_arrays_of_any_rank(spark, folder):
    cube = np.arange(2 * 3 * 7, dtype=np.float32).reshape(2, 3, 7)
    np.save(os.path.join(folder, "cube.npy"), cube)
    np.save(os.path.join(folder, "turned.npy"), np.asfortranarray(cube))
    np.save(os.path.join(folder, "line.npy"), np.arange(9, dtype=np.int16))
    for size in (24, 1 << 20):
        rows = npy.samples(npy.read_headers(spark, folder), size).collect()
        for name in ("cube", "turned"):
            own = sorted((r.t, r.x) for r in rows if r.rec_id == name)
            assert [x for _, x in own] == cube.reshape(6, 7).T.tolist()
        assert sorted((r.t, r.x) for r in rows if r.rec_id == "line") == [(t, [float(t)]) for t in range(9)]


def test_saved_lists(spark, folder):
    lists = {"p_continuous": np.array([0.5, np.nan, 2.0]), "kinds": np.array(["é", "speaker", ""]), "raw": np.array([b"a", b"bc", b""]), "none_continuous": np.zeros(0)}
    for name, held in lists.items():
        np.save(os.path.join(folder, f"{name}.npy"), held)
    found = npy.values(npy.read_headers(spark, folder), 8)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.t):
        got.setdefault(r.rec_id, []).append((r.label, r.y))
    assert got["kinds"] == [("é", None), ("speaker", None), ("", None)] and [x for x, _ in got["raw"]] == ["a", "bc", ""]
    assert [y for _, y in got["p_continuous"]] == [0.5, None, 2.0] and "none_continuous" not in got
    rows = spark.createDataFrame([("p", t) for t in range(4)] + [("q", 0)], "pairing string, t long")
    joined = sorted((r.pairing, r.t, r.y) for r in npy.with_values(rows, found, "_continuous").collect() if r.y is not None)
    assert joined == [("p", 0, 0.5), ("p", 2, 2.0)] and npy.with_values(rows, found, "_continuous").count() == 5


def test_a_rerun_leaves_one_set_of_rows(spark, folder):
    ddl = "acc double, tag string, run_id int"
    path = folder + "/metrics"
    first = spark.createDataFrame([(0.5, "x", 0), (0.6, "x", 1), (0.7, "y", 0)], ddl)
    for kind in ("csv", "parquet"):
        for rows in (first, first, spark.createDataFrame([(0.9, "x", 1)], ddl)):
            tables.record_runs(rows, f"{path}-{kind}", ["tag", "run_id"], kind)
        assert sorted(map(tuple, tables.read_runs(spark, f"{path}-{kind}", ddl, kind).collect())) == [(0.5, "x", 0), (0.7, "y", 0), (0.9, "x", 1)]


def test_half_of_nulls_and_empty_lists(spark):
    table = spark.createDataFrame([(0, [0.1, 70000.0]), (1, None), (2, []), (3, [1 / 3])], "k int, x array<double>")
    got = {r.k: r.h for r in table.select("k", half("x").alias("h")).collect()}
    assert got[0] == [float(np.float16(0.1)), float("inf")] and got[1] is None and got[2] == [] and got[3] == [float(np.float16(1 / 3))]
