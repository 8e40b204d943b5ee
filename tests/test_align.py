import numpy as np
import pytest

from pairsignal.operators import align

DYADS = "dyad_id string, pairing string, rec_a string, role_a string, rec_b string, role_b string"


def frame(spark, recordings):
    rows = [(name, t, [float(v) for v in x[:, t]]) for name, x in recordings.items() for t in range(x.shape[1])]
    return spark.createDataFrame(rows, "rec_id string, t bigint, x array<double>")


def meta(spark, recordings, sfreq=2.0):
    return spark.createDataFrame([(n, sfreq, x.shape[1], x.shape[0]) for n, x in recordings.items()], "rec_id string, sfreq double, n_samples bigint, n_channels int")


def dyads(spark, *pairs):
    return spark.createDataFrame([(f"d{i}", f"p{i}", a, "speaker", b, "listener") for i, (a, b) in enumerate(pairs)], DYADS)


def expected(a, b, notes, sfreq):
    """Mask, kept parts and segments of one dyad, by plain loops."""
    n = max(a.shape[1], b.shape[1])
    blank = np.zeros(n, dtype=bool)
    for x, own in ((a, notes[0]), (b, notes[1])):
        whole = np.zeros((x.shape[0], n))
        whole[:, : x.shape[1]] = x
        for onset, duration in own:
            whole[:, max(int(onset * sfreq), 0) : max(int((onset + duration) * sfreq), 0)] = 0
        blank |= (whole == 0).all(axis=0)
    spans, start = [], 0
    for t in range(1, n + 1):
        if t == n or blank[t] != blank[start]:
            spans.append(("cut" if blank[start] else "keep", start, t))
            start = t
    return blank, spans


@pytest.mark.parametrize("block", [3, 65536])
def test_mutual_alignment_against_loops(spark, block):
    rng = np.random.default_rng(3)
    recs, notes = {}, {}
    for k in range(6):
        x = rng.standard_normal((3, int(rng.integers(5, 40))))
        x[:, rng.random(x.shape[1]) < 0.2] = 0
        x[0, rng.random(x.shape[1]) < 0.3] = 0
        recs[f"r{k}"] = x
        notes[f"r{k}"] = [(float(rng.uniform(-2, 20)), float(rng.choice([0.0, 0.3, 4.0, 60.0], p=[0.3, 0.3, 0.3, 0.1]))) for _ in range(3)]
    recs["r1"][0, 0] = np.nan
    pairs = [("r0", "r1"), ("r2", "r3"), ("r4", "r5")]
    table = spark.createDataFrame([(n, o, d, "cut") for n, own in notes.items() for o, d in own], "rec_id string, onset_s double, duration_s double, description string")
    out = align.mutually_align(frame(spark, recs), meta(spark, recs), dyads(spark, *pairs), table, block=block)
    segments, samples, shared = out.segments.collect(), out.samples.collect(), out.annotations.collect()
    for i, (a, b) in enumerate(pairs):
        blank, spans = expected(recs[a], recs[b], (notes[a], notes[b]), 2.0)
        mine = sorted((s["start_t"], s["kind"], s["end_t"], s["onset_src"], s["onset_dst"], s["duration_s"]) for s in segments if s["dyad_id"] == f"d{i}")
        want = [(s, kind, e, s / 2.0, (s - blank[:s].sum()) / 2.0, (e - s) / 2.0) for kind, s, e in spans]
        assert mine == want
        cuts = [w for w in want if w[1] == "cut"]
        assert sum(1 for s in shared if s["dyad_id"] == f"d{i}") == 2 * len(cuts)
        for side, name in (("a", a), ("b", b)):
            got = sorted((r["t"], r["x"]) for r in samples if r["dyad_id"] == f"d{i}" and r["side"] == side)
            keep = recs[name][:, np.flatnonzero(~blank)] if (~blank).any() else np.zeros((3, 0))
            assert [t for t, _ in got] == list(range(keep.shape[1]))
            if len(got):
                assert np.array_equal(np.array([x for _, x in got]), keep.T, equal_nan=True)


def test_swapping_the_recordings_gives_the_same_segments(spark):
    rng = np.random.default_rng(5)
    recs = {n: rng.standard_normal((2, 30)) * (rng.random(30) < 0.6) for n in "ab"}
    one = align.mutually_align(frame(spark, recs), meta(spark, recs), dyads(spark, ("a", "b"))).segments
    two = align.mutually_align(frame(spark, recs), meta(spark, recs), dyads(spark, ("b", "a"))).segments
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_nothing_left_is_no_rows(spark):
    recs = {"a": np.zeros((2, 4)), "b": np.ones((2, 6))}
    out = align.mutually_align(frame(spark, recs), meta(spark, recs), dyads(spark, ("a", "b")))
    assert out.samples.count() == 0
    assert [(s["kind"], s["start_t"], s["end_t"]) for s in out.segments.collect()] == [("cut", 0, 6)]


def test_description_filter_and_zeroing(spark):
    recs = {"a": np.ones((2, 6))}
    notes = spark.createDataFrame([("a", 0.5, 1.0, "cut"), ("a", 0.0, 9.0, "other")], "rec_id string, onset_s double, duration_s double, description string")
    for block in (2, 100):
        for description, zero in (("cut", [1, 2]), (None, [0, 1, 2, 3, 4, 5])):
            edges = align.annotation_edges(notes, meta(spark, recs), description)
            rows = align.zero_annotated(frame(spark, recs), edges, block).orderBy("t").collect()
            assert [r["t"] for r in rows if r["x"] == [0.0, 0.0]] == zero and len(rows) == 6


def test_padding_across_blocks(spark):
    recs = {"a": np.ones((2, 3)), "b": np.ones((1, 11))}
    rows = align.pad_lengths(frame(spark, recs), dyads(spark, ("a", "b")), meta(spark, recs), block=4).filter("side = 'a'").orderBy("t").collect()
    assert [r["t"] for r in rows] == list(range(11))
    assert [r["x"] for r in rows] == [[1.0, 1.0]] * 3 + [[0.0, 0.0]] * 8


@pytest.mark.parametrize("block", [2, 5, 100])
def test_run_edges_do_not_depend_on_blocks(spark, block):
    cut = [0, 1, 1, 0, 0, 1, 1, 1, 1, 0, 1]
    mask = spark.createDataFrame([("d", t, bool(c)) for t, c in enumerate(cut)], "dyad_id string, t bigint, cut boolean")
    edges = sorted((r["t"], r["edge"]) for r in align.run_edges(mask, block).collect())
    step = np.diff([0, *cut, 0])
    assert edges == [(int(t), int(step[t])) for t in np.flatnonzero(step)]
