import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from pairsignal.functions import chunks, vectors
from pairsignal.operators import embed, knn, score
from pairsignal.session import settle

SCHEMA = "pairing string, run_id int, t bigint, e array<double>, label int, split string"


def embedded(spark, e, labels=None, pairing="p", run=0, test_every=5):
    rows = [
        (pairing, run, t, [float(v) for v in row], int(labels[t]) if labels is not None else 0, "test" if t % test_every == test_every - 1 else "train")
        for t, row in enumerate(e)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def sphere_points(n, d=3, seed=0):
    e = np.random.default_rng(seed).standard_normal((n, d))
    return e / np.linalg.norm(e, axis=1, keepdims=True)


def brute_neighbours(train, train_ids, queries, k):
    sims = np.round(queries @ train.T, 10)
    return [sorted(zip(-s, train_ids))[:k] for s in sims]


@pytest.mark.parametrize("k,copies,piece", [(1, False, 2048), (3, True, 2048), (7, True, 16), (400, False, 64)])
def test_neighbours_against_brute_force(spark, monkeypatch, k, copies, piece):
    monkeypatch.setattr(knn, "PIECE", piece)
    monkeypatch.setattr(knn, "PER_PIVOT", 12)
    e = sphere_points(420)
    if copies:
        e[np.random.default_rng(1).random(420) < 0.4] = e[0]
    labels = np.random.default_rng(2).integers(0, 3, 420)
    rows = embedded(spark, e, labels).unionByName(embedded(spark, sphere_points(60, seed=3), labels, "q", 1))
    got = knn.nearest_neighbours(rows.filter("split = 'train'"), rows.filter("split = 'test'"), k).collect()
    ids = np.arange(420)
    train, test = ids % 5 != 4, ids % 5 == 4
    want = brute_neighbours(e[train], ids[train], e[test], k)
    found = {}
    for r in got:
        if r["pairing"] == "p":
            found.setdefault(r["qid"], []).append((r["rank"], r["nid"], r["label"]))
    assert set(found) == set(ids[test])
    for q, best in zip(ids[test], want):
        assert [(n, label) for _, n, label in sorted(found[q])] == [(i, labels[i]) for _, i in best]
    assert {r["run_id"] for r in got if r["pairing"] == "q"} == {1}


@pytest.mark.parametrize("k,lattice", [(1, False), (40, False), (90, True), (5000, False)])
def test_counted_vote_agrees_with_listed_vote(spark, monkeypatch, k, lattice):
    monkeypatch.setattr(knn, "PIECE", 32)
    monkeypatch.setattr(knn, "PER_PIVOT", 20)
    monkeypatch.setattr(knn, "BANDS", 4)
    rng = np.random.default_rng(6)
    e = rng.integers(-1, 2, (300, 3)).astype(float) + [0, 0, 3] if lattice else sphere_points(300)
    e[rng.random(300) < 0.3] = e[0]
    labels = rng.integers(0, 3, 300) * 2
    rows = embedded(spark, e, labels)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    listed = knn.vote(knn.nearest_neighbours(train, test, k))
    counted = knn.counted_vote(train, test, k)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, listed.collect()))


@pytest.mark.parametrize("k", [30, 150])
def test_counted_vote_with_many_labels(spark, monkeypatch, k):
    monkeypatch.setattr(knn, "PIECE", 64)
    monkeypatch.setattr(knn, "FIRSTS", 4)
    rng = np.random.default_rng(8)
    e = sphere_points(400)
    e[rng.random(400) < 0.4] = e[0]
    rows = embedded(spark, e, rng.integers(0, 300, 400))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    listed, counted = knn.vote(knn.nearest_neighbours(train, test, k)), knn.counted_vote(train, test, k)
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, listed.collect()))


def test_square_root_of_the_training_rows(spark):
    e, labels = sphere_points(130), np.random.default_rng(2).integers(0, 2, 130)
    small, small_labels = sphere_points(20, seed=4), np.random.default_rng(3).integers(0, 2, 20)
    rows = embedded(spark, e, labels).unionByName(embedded(spark, small, small_labels, "q"))
    got = knn.decode(rows.filter("split = 'train'"), rows.filter("split = 'test'"), "sqrt").collect()
    for name, k in (("p", 10), ("q", 4)):
        part = rows.filter(f"pairing = '{name}'")
        want = knn.vote(knn.nearest_neighbours(part.filter("split = 'train'"), part.filter("split = 'test'"), k)).collect()
        assert sorted(map(tuple, want)) == sorted(tuple(r) for r in got if r["pairing"] == name)


def test_far_groups_are_not_compared(spark, monkeypatch):
    """Routes leave out training groups that cannot hold a neighbour."""
    monkeypatch.setattr(knn, "PER_PIVOT", 20)
    rng = np.random.default_rng(0)
    centres = np.eye(3)
    e = np.vstack([c + 0.01 * rng.standard_normal((200, 3)) for c in centres])
    rows = embedded(spark, e / np.linalg.norm(e, axis=1, keepdims=True)).withColumn("vid", F.col("t"))
    chosen = knn._choose_pivots(rows, 64)
    placed = knn._to_pivots(rows.select("pairing", "run_id", "vid", "e"), chosen)
    routes = knn._routes(placed, placed, chosen, 3)
    assert routes.count() < chosen.first()["n_pivots"] ** 2 / 2


def pairs_compared(spark, monkeypatch, n, most):
    """Comparisons of a join of n vectors with themselves, once its pivots are chosen."""
    rows = embedded(spark, sphere_points(n)).withColumn("vid", F.col("t"))
    chosen = settle(knn._choose_pivots(rows, most, 16))
    placed = settle(knn._to_pivots(rows.select("pairing", "run_id", "vid", "e"), chosen))
    sent = knn._send(placed, placed, chosen, 3, knn._most(chosen)).groupBy("cell").count().withColumnRenamed("count", "sent")
    cells = placed.groupBy("cell").count().join(sent, "cell")
    return chosen.first()["n_pivots"], cells.agg(F.sum(F.col("count") * F.col("sent"))).first()[0]


def test_comparisons_grow_slower_than_pairs(spark, monkeypatch):
    """On ten times the vectors pivots grow with the root, and comparisons less than half as fast as the square."""
    monkeypatch.setattr(knn, "PER_PIVOT", 8)
    few, small = pairs_compared(spark, monkeypatch, 1500, 8)
    many, large = pairs_compared(spark, monkeypatch, 15000, 8)
    assert few == 39 and many == 123
    assert large < 50 * small


@pytest.mark.parametrize("k", [1, 5, 300])
def test_neighbours_with_grouped_pivots(spark, monkeypatch, k):
    """More pivots than are looked through one by one: the neighbours stay exact."""
    monkeypatch.setattr(knn, "PER_PIVOT", 4)
    monkeypatch.setattr(knn, "ROUTED", 3)
    grouped = knn._choose_pivots
    monkeypatch.setattr(knn, "_choose_pivots", lambda train, pivots: grouped(train, pivots, 5))
    e = sphere_points(900, d=4)
    e[np.random.default_rng(1).random(900) < 0.2] = e[0]
    labels = np.random.default_rng(2).integers(0, 3, 900)
    rows = embedded(spark, e, labels)
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    got = knn.nearest_neighbours(train, test, k, pivots=2).collect()
    ids = np.arange(900)
    kept, asked = ids[ids % 5 != 4], ids[ids % 5 == 4]
    found = {}
    for r in got:
        found.setdefault(r["qid"], []).append((r["rank"], r["nid"]))
    for q, best in zip(asked, brute_neighbours(e[kept], kept, e[asked], k)):
        assert [n for _, n in sorted(found[q])] == [i for _, i in best]


def test_vote_ties_go_to_the_smaller_label(spark):
    rows = spark.createDataFrame([("p", 0, 1, r, r, lab, 1.0) for r, lab in enumerate([2, 1, 2, 1, 0])], "pairing string, run_id int, qid bigint, rank int, nid bigint, label int, sim double")
    assert tuple(knn.vote(rows).first()) == ("p", 0, 1, 1, 2)


def test_r2_and_accuracy(spark):
    rows = spark.createDataFrame([("p", 1.0, 1.0), ("p", 2.0, 3.0), ("p", 4.0, 4.0), ("q", 5.0, 4.0), ("q", 5.0, 5.0)], "pairing string, y double, pred double")
    r2 = {r["pairing"]: r["r2"] for r in score.r_squared(rows, ["pairing"]).collect()}
    y = np.array([1, 2, 4])
    assert r2["p"] == pytest.approx(1 - 1 / ((y - y.mean()) ** 2).sum()) and r2["q"] is None
    acc = {r["pairing"]: r["accuracy"] for r in score.accuracy(rows, ["pairing"], "y", "pred").collect()}
    assert acc == {"p": pytest.approx(2 / 3), "q": 0.5}


@pytest.mark.parametrize("block", [7, 1000])
def test_infonce_against_numpy(spark, block):
    e = sphere_points(60)
    ends = spark.createDataFrame([("p", 60)], "pairing string, n_samples bigint")
    got = score.infonce(embedded(spark, e), ends, batch=16, block=block).first()
    losses = []
    for t in range(50):
        others = [s for s in range(50) if s % 4 == t % 4 and s != t]
        losses.append((np.log(np.exp(e[others] @ e[t] / 1.12).sum()) - e[t] @ e[t + 10] / 1.12, np.log(len(others))))
    losses = np.array(losses)
    assert got["n"] == 50 and got["loss"] == pytest.approx(losses[:, 0].mean())
    assert got["bits"] == pytest.approx(((losses[:, 1] - losses[:, 0]) / np.log(2)).mean())


def test_consistency_of_linear_images_is_one(spark):
    a = sphere_points(80)
    m = np.array([[2.0, 1, 0], [0, 1, 0.5], [1, 0, 3]])
    noise = sphere_points(80, seed=9)
    rows = embedded(spark, a, run=0).unionByName(embedded(spark, a @ m + 4, run=1)).unionByName(embedded(spark, noise, run=2))
    got = {(r["run_i"], r["run_j"]): r for r in score.run_consistency(rows, block=16).collect()}
    assert len(got) == 6
    assert got[0, 1]["r2"] == pytest.approx(1) and got[1, 0]["r2_weighted"] == pytest.approx(1)

    def r2(x, y):
        x = np.hstack([x, np.ones((len(x), 1))])
        rest = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        sse, sst = (rest**2).sum(axis=0), ((y - y.mean(axis=0)) ** 2).sum(axis=0)
        return (1 - sse / sst).mean(), 1 - sse.sum() / sst.sum()

    assert (got[0, 2]["r2"], got[0, 2]["r2_weighted"]) == pytest.approx(r2(a, noise))
    assert (got[2, 0]["r2"], got[2, 0]["r2_weighted"]) == pytest.approx(r2(noise, a))
    out = score.variability(score.run_consistency(rows), spark.createDataFrame([("p",), ("alone",)], "pairing string")).collect()
    by = {r["pairing"]: r for r in out}
    assert by["p"]["variability"] == pytest.approx(1 - by["p"]["mean_consistency"]) and by["alone"]["variability"] is None


def test_failed_runs_are_left_out(spark):
    rows = embedded(spark, sphere_points(5), run=0).unionByName(embedded(spark, np.full((5, 3), np.nan), run=1))
    expected = spark.createDataFrame([("p", 0), ("p", 1), ("p", 2)], "pairing string, run_id int")
    status = score.run_status(expected, rows)
    assert {r["run_id"]: r["ok"] for r in status.collect()} == {0: True, 1: False, 2: False}
    assert {r["run_id"] for r in score.successful_runs(rows, status).collect()} == {0}


def test_class_distance_against_pairs(spark):
    e, labels = sphere_points(40), np.random.default_rng(1).integers(0, 3, 40)
    got = score.class_distance(embedded(spark, 3 * e, labels), ["pairing"]).first()
    d = 1 - e @ e.T
    same = (labels[:, None] == labels) & ~np.eye(40, dtype=bool)
    assert got["intra"] == pytest.approx(d[same].mean()) and got["inter"] == pytest.approx(d[labels[:, None] != labels].mean())


def test_l1_regression_agrees_with_spark_ml(spark):
    e = sphere_points(200)
    y = e @ [3.0, 0.0, -1.0] + 0.5 + 0.1 * np.random.default_rng(5).standard_normal(200)
    rows = embedded(spark, e).join(spark.createDataFrame([(t, float(v)) for t, v in enumerate(y)], "t bigint, y double"), "t")
    got = score.l1_regression(rows, 0.05, block=64).first()
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f").transform(
        rows.filter("split = 'train'").select("y", *[F.get("e", F.lit(i)).alias(n) for i, n in enumerate("abc")])
    )
    model = LinearRegression(featuresCol="f", labelCol="y", regParam=0.05, elasticNetParam=1.0, standardization=False, solver="l-bfgs", tol=1e-12, maxIter=1000)
    # The library scales the target before it penalises; undo that by scaling the penalty.
    fitted = model.copy().fit(data)
    assert np.allclose(got["coef"], fitted.coefficients.toArray(), atol=0.02)
    x, t = e[[i for i in range(200) if i % 5 != 4]], y[[i for i in range(200) if i % 5 != 4]]

    def cost(w, b):
        return ((t - x @ w - b) ** 2).mean() / 2 + 0.05 * np.abs(w).sum()

    best = cost(np.array(got["coef"]), got["intercept"])
    rng = np.random.default_rng(0)
    assert all(cost(np.array(got["coef"]) + 0.01 * rng.standard_normal(3), got["intercept"] + 0.01 * rng.standard_normal()) >= best for _ in range(200))
    scored = score.decode_continuous(rows.drop("y"), rows.select("pairing", "t", "y"), 0.01).first()
    assert 0.8 < scored["cont_r2"] < 1
    assert score.decode_continuous(rows.drop("y"), None).first()["cont_r2"] is None


def test_fit_history(spark):
    rows = spark.createDataFrame([("p", 0, i, loss) for i, loss in enumerate([6.0, 5.0, 5.5])], "pairing string, run_id int, iter int, loss double")
    got = score.history_summary(score.fit_history(rows)).first()
    value = lambda loss: (np.log(512) - loss) / np.log(2)
    assert (got["n_iter"], got["best_iter"]) == (3, 1)
    assert got["best_bits"] == pytest.approx(value(5.0)) and got["last_bits"] == pytest.approx(value(5.5))


@pytest.mark.parametrize("block", [4, 1000])
def test_receptive_field(spark, block):
    x = np.arange(30.0).reshape(15, 2)
    rows = spark.createDataFrame([("r", t, [float(v) for v in row]) for t, row in enumerate(x)], "rec_id string, t bigint, x array<double>")
    drop = {r["t"]: r["x"] for r in embed.receptive_field(rows, block=block).collect()}
    assert set(drop) == set(range(5, 11))
    assert all(v == x[t - 5 : t + 5].ravel().tolist() for t, v in drop.items())
    keep = {r["t"]: r["x"] for r in embed.receptive_field(rows, edges="replicate", block=block).collect()}
    padded = np.vstack([x[:1]] * 5 + [x] + [x[-1:]] * 4)
    assert {t: padded[t : t + 10].ravel().tolist() for t in range(15)} == keep


@pytest.mark.parametrize("block", [3, 1000])
def test_positive_pairs(spark, block):
    rows = embedded(spark, sphere_points(23))
    got = sorted((r["t"], r["t_pos"]) for r in embed.positive_pairs(rows, block=block).collect())
    assert got == [(t, t + 10) for t in range(13)]


@pytest.mark.parametrize("pieces", [1, 8, 1024])
def test_nearest_label_against_brute_force(spark, pieces):
    rng = np.random.default_rng(3)
    y = np.where(rng.random(80) < 0.4, 0.0, rng.integers(-40, 40, 80) / 8)
    target = rng.uniform(-7, 7, 50)
    labels = spark.createDataFrame([("p", t, float(v)) for t, v in enumerate(y)], "pairing string, t bigint, y double")
    wanted = spark.createDataFrame([("p", t, float(v)) for t, v in enumerate(target)], "pairing string, t bigint, target double")
    keys = labels.select("pairing").distinct()
    got = {r["t"]: (r["y_pos"], r["t_pos"]) for r in embed.nearest(wanted, labels, keys, "pairing", pieces).collect()}
    assert got == {i: min((abs(v - yy), yy, t) for t, yy in enumerate(y))[1:] for i, v in enumerate(target)}
    pairs = embed.nearest_label_pairs(labels, keys).collect()
    assert len(pairs) == 80 and all(r["y_pos"] in y for r in pairs)


def test_linear_embedding_finds_the_slow_directions(spark):
    rng = np.random.default_rng(4)
    n = 1500
    slow = np.stack([np.sin(2 * np.pi * np.arange(n) / p) for p in (300, 410, 530)], axis=1)
    x = np.hstack([slow, 5 * rng.standard_normal((n, 4))]) @ rng.standard_normal((7, 7))
    samples = spark.createDataFrame([("p", t, [float(v) for v in row]) for t, row in enumerate(x)], "pairing string, t bigint, x array<double>")
    ends = spark.createDataFrame([("p", n, int(0.8 * n))], "pairing string, n_samples bigint, n_train bigint")
    rows = embed.embed_linear(samples, ends, runs=2).collect()
    assert len(rows) == 2 * n
    for run in (0, 1):
        e = np.array([r["e"] for r in sorted((r for r in rows if r["run_id"] == run), key=lambda r: r["t"])])
        assert np.allclose(np.linalg.norm(e, axis=1), 1)
        assert np.median((e[:-10] * e[10:]).sum(axis=1)) > 0.9
    one = embed.embed_linear(samples, ends, runs=2, block=100).collect()
    key = lambda r: (r["run_id"], r["t"])
    assert np.allclose([r["e"] for r in sorted(one, key=key)], [r["e"] for r in sorted(rows, key=key)], atol=1e-6)


def test_label_embedding_separates_classes(spark):
    rng = np.random.default_rng(5)
    labels = np.arange(300) % 3
    x = np.eye(6)[labels] + 0.1 * rng.standard_normal((300, 6))
    samples = spark.createDataFrame([("p", t, [float(v) for v in row], int(labels[t])) for t, row in enumerate(x)], "pairing string, t bigint, x array<double>, y int")
    ends = spark.createDataFrame([("p", 300, 240)], "pairing string, n_samples bigint, n_train bigint")
    rows = embed.embed_linear(samples, ends, mode="label", runs=1).join(samples.select("t", F.col("y").alias("label")), "t")
    d = score.class_distance(rows, ["pairing"]).first()
    assert d["intra"] < 0.3 < d["inter"]


def test_half_precision_and_vector_functions(spark):
    values = [0.1, -3.14159, 65504.0, 1e-7, 0.0]
    row = spark.createDataFrame([(values, [1.0, 2.0, 2.0], [0.0, 0.0, 0.0])], "x array<double>, a array<double>, z array<double>").select(
        vectors.half("x").alias("h"), vectors.norm(F.col("a")).alias("n"), vectors.unit(F.col("z")).alias("z"),
        vectors.cosine(F.col("a"), F.col("z")).alias("c"), vectors.as_array(F.col("a"), "tinyint").alias("b"),
    ).first()
    assert np.array_equal(np.array(row["h"], dtype=np.float32), np.array(values).astype(np.float16).astype(np.float32))
    assert row["n"] == 3.0 and row["z"] == [0.0, 0.0, 0.0] and row["c"] is None and row["b"] == [1, 2, 2]


@pytest.mark.parametrize("k", [3, 40, "sqrt"])
def test_vectors_of_many_dimensions_are_not_sent_by_pivots(spark, monkeypatch, k):
    """Where pivots leave nothing out, a training vector is not copied to every group of queries; all answers stay exact."""
    monkeypatch.setattr(knn, "PIECE", 64)
    monkeypatch.setattr(knn, "PER_PIVOT", 16)
    monkeypatch.setattr(knn, "GRID", 6)
    monkeypatch.setattr(knn, "ROWS", 7)
    rng = np.random.default_rng(4)
    e = sphere_points(1000, d=24, seed=4)
    e[rng.random(1000) < 0.1] = e[1]
    labels = rng.integers(0, 4, 1000)
    rows = embedded(spark, e, labels).withColumn("label", F.nullif(F.concat(F.lit("l"), "label"), F.lit("l3")))
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")

    def sent(*_):
        raise AssertionError("sent by pivots")

    monkeypatch.setattr(knn, "_send", sent)
    ids = np.arange(1000)
    known, asks = ids % 5 != 4, ids % 5 == 4
    first = {}
    named = [first.setdefault(tuple(v), i) for i, v in zip(ids[known], e[known])]
    n = int(np.sqrt(known.sum())) if k == "sqrt" else k
    sims = np.round(e[asks] @ e[known].T, 10)
    want = [[i for _, _, i in sorted(zip(-s, named, ids[known]))[:n]] for s in sims]
    if k != "sqrt":
        got = {}
        for r in knn.nearest_neighbours(train, test, k).collect():
            got.setdefault(r.qid, []).append((r.rank, r.nid, r.label))
        for q, best in zip(ids[asks], want):
            assert sorted(got[q]) == [(j + 1, i, None if labels[i] == 3 else f"l{labels[i]}") for j, i in enumerate(best)]
    votes = {r.qid: (r.pred, r.votes) for r in knn.decode(train, test, k).collect()}
    if k == 40:
        assert votes == {r.qid: (r.pred, r.votes) for r in knn.counted_vote(train, test, k).collect()}
    assert set(votes) == set(ids[asks])
    for q, best in zip(ids[asks], want):
        counts = {c: sum(labels[i] == c for i in best) for c in (3, 0, 1, 2)}  # null is the smallest label
        pred = max(counts, key=counts.get)
        assert votes[q] == (None if pred == 3 else f"l{pred}", counts[pred])


def test_small_spaces_need_no_pivots(spark, monkeypatch):
    """Spaces of one chunk are answered in one task each, with copies and ties, beside spaces that are larger."""
    rng = np.random.default_rng(9)
    rows, parts = None, {}
    for name, n in (("a", 40), ("b", 7), ("large", 200)):
        e = sphere_points(n, seed=n)
        e[rng.random(n) < 0.3] = e[0]
        labels = rng.integers(0, 3, n)
        parts[name] = e, labels
        own = embedded(spark, e, labels, name)
        rows = own if rows is None else rows.unionByName(own)
    train = rows.filter("split = 'train'")
    chosen = knn._choose_pivots
    seen = []
    monkeypatch.setattr(knn, "_choose_pivots", lambda units, pivots: seen.extend(r.pairing for r in units.select("pairing").distinct().collect()) or chosen(units, pivots))
    monkeypatch.setattr(knn, "PIECE", 64)
    monkeypatch.setattr(knn, "PER_PIVOT", 16)
    for k in (3, 20):
        seen.clear()
        got = {}
        for r in knn.nearest_neighbours(train, rows, k).collect():
            got.setdefault((r.pairing, r.qid), []).append((r["rank"], r.nid, r.label))
        assert seen == ["large"]
        voted = {(r.pairing, r.qid): (r.pred, r.votes) for r in knn.decode(train, rows, k).collect()}
        for name, (e, labels) in parts.items():
            ids = np.arange(len(e))
            known = ids % 5 != 4
            first = {}
            named = [first.setdefault(tuple(v), i) for i, v in zip(ids[known], e[known])]
            for q in ids:
                s = np.round(e[q] @ e[known].T, 10)
                best = [i for _, _, i in sorted(zip(-s, named, ids[known]))[:k]]
                assert sorted(got[name, q]) == [(j + 1, i, labels[i]) for j, i in enumerate(best)]
                counts = np.bincount(labels[best], minlength=3)
                assert voted[name, q] == (counts.argmax(), counts.max())


def test_sums_of_vectors_are_not_shuffled_by_element(spark):
    """A partial sum is one row of the shuffle, however long; keys in many partitions add up."""
    rows = spark.range(0, 3000, 1, 7).select((F.col("id") % 5).cast("string").alias("pairing"), (F.col("id") % 40).cast("int").alias("run_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))

    def each(row):
        yield (row["pairing"], row["run_id"]), row["v"]

    got = chunks.summed(rows, ["pairing", "run_id"], each, "pairing string, run_id int")
    want = {}
    for i in range(3000):
        want.setdefault((str(i % 5), i % 40), []).append(i)
    assert {(r.pairing, r.run_id): list(r.v) for r in got.collect()} == {k: [float(sum(v)), float(len(v))] for k, v in want.items()}
    assert got.count() == len(want)
    assert "Generate" not in got._jdf.queryExecution().toString()


def as_whole(spark, rows, n_train):
    """Rows of ``embedded`` as whole chunks; rows before ``n_train`` are the training rows."""
    spaces = {}
    for r in sorted(rows.collect(), key=lambda r: r["t"]):
        spaces.setdefault((r["pairing"], r["run_id"]), []).append(r)
    packed = [
        (*key, max(r["t"] for r in v) + 1, n_train, np.array([r["t"] for r in v]).tobytes(), np.array([r["e"] for r in v], float).tobytes(),
         np.array([r["label"] for r in v], float).tobytes())
        for key, v in spaces.items()
    ]
    return spark.createDataFrame(packed, "pairing string, run_id int, n_samples bigint, n_train bigint, ts binary, es binary, label binary")


@pytest.mark.parametrize("k,copies", [(3, 0.0), (3, 0.5), (5, 1.0), (40, 0.3), ("sqrt", 0.5)])
def test_whole_chunks_are_decoded_like_rows(spark, k, copies):
    rng = np.random.default_rng(6)
    rows = None
    for run in range(2):
        e = sphere_points(150, seed=run)
        e[rng.random(150) < copies] = e[7]
        one = embedded(spark, e, rng.integers(0, 4, 150), run=run)
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.filter("t % 11 <> 3")
    whole = as_whole(spark, rows, 110)
    want = knn.decode(rows.filter("t < 110"), rows, k).collect()
    got = knn.decode(whole, whole, k)
    assert {r["n_fit"] for r in got.collect()} == {100}
    got = chunks.unpacked(got, ["pairing", "run_id"], "pred", "x").join(
        chunks.unpacked(got, ["pairing", "run_id"], "votes", "v"), ["pairing", "run_id", "t"]
    )
    assert sorted((r["run_id"], r["t"], r["x"][0], r["v"][0]) for r in got.collect()) == sorted((r["run_id"], r["qid"], r["pred"], r["votes"]) for r in want)


@pytest.mark.parametrize("copies", [0.0, 0.8])
def test_scores_of_whole_chunks_are_those_of_rows(spark, copies):
    rng = np.random.default_rng(8)
    e = sphere_points(200, seed=9)
    e[rng.random(200) < copies] = e[3]
    e[120:140] *= 0
    rows = embedded(spark, e, rng.integers(0, 2, 200)).filter("t not in (50, 51, 90)")
    broken = embedded(spark, sphere_points(30), run=1).withColumn("e", F.when(F.col("t") == 4, F.array(*[F.lit(float("nan"))] * 3)).otherwise(F.col("e")))
    rows, lengths = rows.unionByName(broken), spark.createDataFrame([("p", 200)], "pairing string, n_samples bigint")
    whole = as_whole(spark, rows, 120)
    whole = whole.withColumn("n_samples", F.lit(200).cast("bigint"))
    expected = spark.createDataFrame([("p", 0), ("p", 1), ("p", 2)], "pairing string, run_id int")
    status = score.run_status(expected, whole)
    assert {tuple(r) for r in status.collect()} == {("p", 0, True), ("p", 1, False), ("p", 2, False)}
    good = score.successful_runs(whole, status)
    rows = score.successful_runs(rows, score.run_status(expected, rows))
    assert good.count() == 1
    marked = rows.withColumn("split", F.when(F.col("t") < 120, "train").otherwise("test"))
    assert score.split_counts(good, ["pairing", "run_id"]).collect() == score.split_counts(marked, ["pairing", "run_id"]).collect()
    for batch in (64, 1):
        a, b = score.infonce(rows, lengths, batch=batch).collect(), score.infonce(good, lengths, batch=batch).collect()
        assert a[0]["n"] == b[0]["n"] == 190 - 23
        assert (a[0]["bits"] is None and b[0]["bits"] is None) or np.allclose(a[0][3:], b[0][3:], rtol=1e-12)
    decoded = knn.decode(good, good, 3)
    voted = knn.decode(marked.filter("split = 'train'"), marked, 3).withColumnRenamed("qid", "t")
    known = marked.drop("e").join(voted, ["pairing", "run_id", "t"])
    for split in ("train", "test"):
        part = chunks.of_split(decoded, split, ["label", "pred"])
        for of, name in ((score.accuracy, "accuracy"), (score.r_squared, "r2")):
            a, b = of(part, ["run_id"], "label", "pred").collect()[0], of(chunks.of_split(known, split, []), ["run_id"], "label", "pred").collect()[0]
            assert a["n"] == b["n"] and np.isclose(a[name], b[name], rtol=1e-12)
