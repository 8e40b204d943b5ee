import os

import numpy as np
import pytest

from pairsignal.functions.spline import spline_weights
from pairsignal.operators import decompose, filters, interpolate, quality, remix
from test_align import frame, meta
from test_prepare import wide


def filtered(x, taps):
    """Point-mirrored, zero-padded convolution of one channel."""
    h, n = len(taps) // 2, len(x)
    whole = np.zeros(n + 2 * h)
    whole[h : h + n] = x
    for k in range(1, h + 1):
        if k < n:
            whole[h - k] = 2 * x[0] - x[k]
            whole[h + n - 1 + k] = 2 * x[-1] - x[n - 1 - k]
    return np.convolve(whole, taps, mode="valid")


@pytest.mark.parametrize("n_taps,block", [(5, 4), (5, 1000), (31, 7), (101, 16), (101, 1000)])
def test_fir_does_not_depend_on_blocks(spark, n_taps, block):
    rng = np.random.default_rng(n_taps)
    recs = {"a": rng.standard_normal((2, 60)), "b": rng.standard_normal((3, 17)), "c": np.ones((1, 1))}
    taps = rng.standard_normal(n_taps)
    got = wide(filters.fir(frame(spark, recs), meta(spark, recs), taps.tolist(), block).collect())
    for name, x in recs.items():
        assert np.allclose(got[name], np.array([filtered(c, taps) for c in x]).T, atol=1e-9)


def test_highpass_removes_slow_and_keeps_fast(spark):
    sfreq = 100.0
    t = np.arange(3000) / sfreq
    slow, fast = np.sin(2 * np.pi * 0.1 * t), np.sin(2 * np.pi * 10 * t)
    recs = {"a": np.stack([slow + 5, fast, slow + fast])}
    out = wide(filters.band(frame(spark, recs), meta(spark, recs, sfreq), 1.0, None, block=512).collect())["a"]
    middle = slice(500, 2500)
    taps = filters.design(sfreq, 1.0, None)
    # The stop band ends at 0 Hz, so 0.1 Hz keeps what the taps' own response leaves of it.
    left = abs(np.sum(taps * np.exp(-2j * np.pi * 0.1 / sfreq * np.arange(len(taps)))))
    assert left < 0.05 and np.abs(out[middle, 0]).max() == pytest.approx(left, rel=0.01)
    assert np.abs(out[middle, 1] - fast[middle]).max() < 0.01
    assert np.abs(out[middle, 2] - fast[middle]).max() < left + 0.01
    assert len(taps) == 331 and np.allclose(taps, taps[::-1])


def test_band_and_low_pass_designs():
    def gain(taps, f, sfreq):
        return abs(np.sum(taps * np.exp(-2j * np.pi * f / sfreq * np.arange(len(taps)))))

    low, band = filters.design(250.0, None, 40.0), filters.design(250.0, 1.0, 40.0)
    assert gain(low, 0, 250) == pytest.approx(1) and gain(low, 60, 250) < 0.01 and gain(low, 30, 250) == pytest.approx(1, abs=0.01)
    assert gain(band, 0, 250) < 0.01 and gain(band, 20, 250) == pytest.approx(1, abs=0.01) and gain(band, 60, 250) < 0.01


@pytest.mark.parametrize("direct", [0, 1000])
def test_quantiles_are_exact(spark, direct):
    rng = np.random.default_rng(7)
    recs = {"a": rng.standard_normal((3, 500)), "b": rng.integers(0, 4, (2, 333)).astype(float), "c": np.array([[1.0, 2.0]])}
    recs["a"][0, :50] = np.nan
    recs["b"][1, :200] = 0.0
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    rows = quality.channel_quantiles(frame(spark, recs), meta(spark, recs), qs, accuracy=100, direct=direct).collect()
    assert len(rows) == 6
    for r in rows:
        x = recs[r["rec_id"]][r["ch_idx"]]
        assert np.allclose(r["q"], np.nanquantile(x, qs)) and r["n"] == np.isfinite(x).sum()


def test_bad_criteria_find_planted_faults(spark):
    rng = np.random.default_rng(11)
    n, sfreq = 2000, 200.0
    shared = np.cumsum(rng.standard_normal(n)) / 10
    x = shared + 0.3 * np.apply_along_axis(lambda v: np.convolve(v, np.ones(9) / 9, "same"), 1, rng.standard_normal((12, n)))
    x[0, 3] = np.nan
    x[1] = 7.0
    x[2] *= 40
    x[3] += 6 * rng.standard_normal(n)
    x[4] = np.convolve(rng.standard_normal(n), np.ones(9) / 9, "same")
    recs = {"a": x}
    samples, shapes = frame(spark, recs), meta(spark, recs, sfreq)

    def found(df):
        return {r["ch_idx"] for r in df.collect()}

    assert found(quality.bad_by_nan(samples)) == {0}
    assert found(quality.bad_by_flat(samples, shapes)) == {1}
    rest = quality.mask_channels(samples, quality.bad_by_nan(samples).unionByName(quality.bad_by_flat(samples, shapes)), shapes)
    assert 2 in found(quality.bad_by_deviation(rest, shapes))
    assert 3 in found(quality.bad_by_hf_noise(rest, shapes))
    assert 4 in found(quality.bad_by_correlation(rest, shapes, 1.0))
    assert not {0, 1} & found(quality.bad_by_deviation(rest, shapes))


def test_low_rates_have_no_hf_criterion(spark):
    recs = {"a": np.random.default_rng(0).standard_normal((4, 100))}
    assert quality.bad_by_hf_noise(frame(spark, recs), meta(spark, recs, 50.0)).count() == 0


def test_window_correlations_against_numpy(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((5, 47))
    x[2, :10] = 1.0
    x[4] = np.nan
    recs = {"a": x}
    got = {(r["win"], r["ch_idx"]): r["corr"] for r in quality.window_correlations(frame(spark, recs), meta(spark, recs, 1.0), 10.0).collect()}
    assert set(got) == {(w, c) for w in range(4) for c in range(4)}
    for w in range(4):
        part = x[:4, w * 10 : (w + 1) * 10]
        with np.errstate(invalid="ignore"):
            c = np.nan_to_num(np.abs(np.corrcoef(part)))
        for i in range(4):
            assert got[w, i] == pytest.approx(np.quantile(np.delete(c[i], i), 0.98))


def sphere(n):
    i = np.arange(n)
    z = 1 - (2 * i + 1) / n
    phi = i * np.pi * (3 - np.sqrt(5))
    return np.stack([np.sqrt(1 - z**2) * np.cos(phi), np.sqrt(1 - z**2) * np.sin(phi), z], axis=1)


def smooth_field(n, t, seed=0):
    """Signals that vary smoothly over the sphere."""
    rng = np.random.default_rng(seed)
    pos = sphere(n)
    return np.hstack([np.ones((n, 1)), pos]) @ rng.standard_normal((4, t))


def net(spark, n, rec="a", bad=()):
    channels = spark.createDataFrame([(rec, i, f"E{i + 1}", "eeg", i in bad) for i in range(n)], "rec_id string, ch_idx int, ch string, type string, bad boolean")
    montage = spark.createDataFrame([(f"E{i + 1}", *map(float, p)) for i, p in enumerate(sphere(n))], "ch string, px double, py double, pz double")
    return channels, montage


def test_ransac_flags_the_channel_that_does_not_fit(spark):
    x = smooth_field(24, 400, 1)
    x[5] = np.random.default_rng(2).standard_normal(400)
    recs = {"a": x}
    channels, montage = net(spark, 24)
    bad = quality.bad_by_ransac(frame(spark, recs), channels, montage, meta(spark, recs, 20.0))
    assert {r["ch_idx"] for r in bad.collect()} == {5}


def test_interpolation_restores_a_smooth_field(spark):
    x = smooth_field(32, 50, 3)
    broken = x.copy()
    broken[[4, 20]] = np.nan
    recs = {"a": broken, "b": x[:8]}
    channels, montage = net(spark, 32, bad=(4, 20))
    channels = channels.unionByName(net(spark, 8, "b")[0])
    fixed, reset = interpolate.interpolate_bads(frame(spark, recs), channels, montage, meta(spark, recs), block=16)
    out = wide(fixed.collect())
    good = [i for i in range(32) if i not in (4, 20)]
    assert np.array_equal(out["a"][:, good], x[good].T) and np.array_equal(out["b"], x[:8].T)
    assert np.abs(out["a"][:, [4, 20]] - x[[4, 20]].T).max() < 0.1 * np.abs(x).max()
    assert reset.filter("bad").count() == 0


def test_spline_weights_reproduce_constants():
    pos = sphere(20)
    w = spline_weights(pos[:15], pos[15:])
    assert np.allclose(w.sum(axis=1), 1, atol=1e-6)


def test_projection_uses_each_recordings_matrix(spark):
    rng = np.random.default_rng(6)
    recs = {"a": rng.standard_normal((3, 9)), "b": rng.standard_normal((3, 4))}
    m = {n: rng.standard_normal((2, 3)) for n in recs}
    weights = spark.createDataFrame([(n, i, [float(v) for v in row]) for n, w in m.items() for i, row in enumerate(w)], "rec_id string, out_idx int, w array<double>")
    out = wide(remix.project(frame(spark, recs), weights, meta(spark, recs), block=4).collect())
    for n in recs:
        assert np.allclose(out[n], recs[n].T @ m[n].T)


def test_components_of_mixed_sources(spark):
    rng = np.random.default_rng(8)
    recs, sources = {}, {}
    for name in "ab":
        s = np.stack([rng.laplace(size=4000), rng.uniform(-1, 1, 4000), np.sign(rng.standard_normal(4000)) + 0.1 * rng.standard_normal(4000)])
        sources[name], recs[name] = s, rng.standard_normal((5, 3)) @ s + rng.standard_normal((5, 1))
    samples, shapes = frame(spark, recs), meta(spark, recs)
    state = decompose.fit_components(samples, shapes, 4, block=512)
    assert all(r["done"] for r in state.collect())
    unmix = {}
    for r in decompose.unmixing(state).collect():
        unmix.setdefault(r["rec_id"], {})[r["out_idx"]] = r["w"]
    dropped = {}
    for name in recs:
        u = np.array([unmix[name][i] for i in range(3)])
        found = u @ (recs[name] - recs[name].mean(axis=1, keepdims=True))
        c = np.abs(np.corrcoef(found, sources[name])[:3, 3:])
        assert sorted(c.argmax(axis=1)) == [0, 1, 2] and c.max(axis=1).min() > 0.98
        dropped[name] = int(c[:, 0].argmax())
    excluded = spark.createDataFrame([("a", [dropped["a"]]), ("b", [])], "rec_id string, comps array<bigint>")
    out = wide(decompose.remove_components(samples, state, excluded, shapes, block=512).collect())
    assert np.allclose(out["b"], recs["b"].T)
    left = np.abs(np.corrcoef(out["a"].T, sources["a"])[:5, 5:])
    assert left[:, 0].max() < 0.1
    assert np.allclose(out["a"].mean(axis=0), recs["a"].mean(axis=1))


def test_component_fits_that_stop_early_are_named(spark):
    draw = np.random.default_rng(4)
    mixed = draw.laplace(size=(400, 4)) @ draw.normal(size=(4, 4))
    samples = spark.createDataFrame([("r", t, x.tolist()) for t, x in enumerate(mixed)], "rec_id string, t long, x array<double>")
    shapes = spark.createDataFrame([("r", 1.0, 400, 4)], "rec_id string, sfreq double, n_samples long, n_channels int")
    with pytest.warns(UserWarning, match="1 recordings have not converged in 1 rounds"):
        decompose.fit_components(samples, shapes, 4, max_rounds=1)
    assert decompose.fit_components(samples, shapes, 4).first().done


def test_components_of_one_chunk_are_found_without_rounds_of_jobs(spark, monkeypatch):
    draw = np.random.default_rng(5)
    recs = {"short": draw.standard_normal((3, 3)) @ draw.laplace(size=(3, 300)), "long": draw.standard_normal((3, 3)) @ draw.laplace(size=(3, 900))}
    samples, shapes = frame(spark, recs), meta(spark, recs)
    both = {r.rec_id: r for r in decompose.fit_components(samples, shapes, 3, block=512).collect()}  # only "long" has two chunks
    split = {r.rec_id: r for r in decompose.fit_components(samples, shapes, 3, block=128).collect()}

    def rounds(*_):
        raise AssertionError("a round of jobs")

    monkeypatch.setattr(decompose, "summed", rounds)
    whole = {r.rec_id: r for r in decompose.fit_components(samples, shapes, 3).collect()}
    assert set(both) == set(split) == set(whole) == set(recs)
    for found in (both, split):
        for name in recs:
            assert found[name].done and whole[name].done
            assert np.allclose(found[name].w, whole[name].w) and np.allclose(found[name].k, whole[name].k)


def test_clean_recordings_excludes_components(spark, sf, monkeypatch):
    from pairsignal import queries

    if not os.path.isdir(sf):
        pytest.skip("no test tables")

    class Stop(Exception):
        pass

    def clean(samples, recordings, table, montage, excluded=None, **options):
        assert "max_rounds" not in options and excluded is not None
        assert {r.rec_id for r in excluded.collect() if r.comps} == {r.rec_id for r in recordings.collect()}
        raise Stop

    monkeypatch.setattr(queries.clean_plan, "clean", clean)
    with pytest.raises(Stop):
        queries.clean_recordings(spark, sf)
