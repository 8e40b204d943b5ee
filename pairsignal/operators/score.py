"""Scores of embeddings: decoding, goodness of fit, consistency between runs, class distances."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsignal.functions.chunks import CHUNK, is_whole, layout, map_chunks, map_spaces, matrix, pack, summed
from pairsignal.functions.vectors import dot, same_rows, unit, unit_rows
from pairsignal.operators.blocks import BLOCK, attach, attach_whole, block_of, row_count
from pairsignal.operators.decompose import split_moments
from pairsignal.operators.embed import OFFSET, positive_pairs
from pairsignal.session import settle

# Temperature and batch size of the contrastive loss.
TEMPERATURE = 1.12
BATCH = 512
LABEL_MODULUS, LABEL_FACTOR = 2**31 - 1, 48271  # spread the samples of a recording over batches, in whole numbers
SPACE = ["pairing", "run_id"]


def accuracy(predicted: DataFrame, keys: list[str], truth: str = "label", guess: str = "pred") -> DataFrame:
    if is_whole(predicted):
        return _per_space(predicted, keys, truth, guess, "accuracy", lambda y, p: (y == p).mean())
    return predicted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy")
    )


def r_squared(predicted: DataFrame, keys: list[str], truth: str = "y", guess: str = "pred") -> DataFrame:
    """``1 - SSE/SST``; NULL where the target does not vary."""
    if is_whole(predicted):
        return _per_space(predicted, keys, truth, guess, "r2", _explained)
    y, p = F.col(truth).cast("double"), F.col(guess).cast("double")
    sums = predicted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum((y - p) * (y - p)).alias("_sse"), F.var_pop(y).alias("_var"),
        F.min(y).alias("_lo"), F.max(y).alias("_hi"),
    )
    sst = F.when(F.col("_hi") > F.col("_lo"), F.col("_var") * F.col("n"))
    return sums.select(*keys, "n", (1 - F.try_divide("_sse", sst)).alias("r2"))


def _per_space(predicted: DataFrame, keys: list[str], truth: str, guess: str, out: str, value: Callable) -> DataFrame:
    """``keys, n`` and a score of each whole chunk's predictions; one without any has no row."""

    def run(row: dict) -> dict | None:
        y, p = row[truth], row[guess]
        return {**{k: row[k] for k in keys}, "n": len(y), out: value(y, p)} if len(y) else None

    columns = predicted.select(*keys, truth, guess)
    return map_spaces(columns, run, f"{layout(columns, *keys)}, n bigint, {out} double")


def _explained(y: np.ndarray, p: np.ndarray) -> float | None:
    return float(1 - ((y - p) ** 2).sum() / (y.var() * len(y))) if y.max() > y.min() else None


def infonce(embedded: DataFrame, recordings: DataFrame, temperature: float = TEMPERATURE, batch: int = BATCH,
            offset: int = OFFSET, block: int = BLOCK) -> DataFrame:
    """Contrastive loss and goodness of fit in bits per (pairing, run).

    Every sample is a reference once.  Batches are strides through the recording, so each holds at most ``batch``
    samples from all over it; a reference meets its later partner and, as negatives, the rest of its batch.
    ``recordings``: ``pairing, n_samples``; whole chunks bring theirs.
    """
    if is_whole(embedded):
        return _infonce_whole(embedded, temperature, batch, offset)
    whole = embedded.withColumn("e", unit(F.col("e")))
    pairs = positive_pairs(whole, SPACE, offset, block)
    strides = recordings.select("pairing", F.ceil(F.col("n_samples") / batch).cast("bigint").alias("_n"))
    batched = attach(pairs, strides, "pairing", bound=recordings).withColumn("batch", F.pmod(F.col("t"), F.col("_n")))
    both = batched.select(*SPACE, "batch", "t", F.concat("e", "e_pos").alias("x"))

    def loss(row: dict) -> dict:
        x = matrix(row)
        e, pos = x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]
        return _batch_loss(row, e, pos, temperature)

    return _goodness(map_chunks(pack(both, SPACE, "batch"), loss, BATCH_LOSS))


def _infonce_whole(embedded: DataFrame, temperature: float, batch: int, offset: int) -> DataFrame:
    def run(row: dict) -> dict | None:
        t, e = row["ts"], unit_rows(matrix(row, values="es"))
        own = np.flatnonzero(t[offset:] == t[: len(t) - offset] + offset) if len(t) > offset else np.zeros(0, np.int64)
        if not len(own):
            return None
        batches, alike = t[own] % -(-row["n_samples"] // batch), same_rows(e)[1][own]
        parts = []
        for b in np.unique(batches):
            at = batches == b
            parts.append(_batch_loss(row, e[own[at]], e[own[at] + offset], temperature, alike[at]))
        total = {c: sum(part[c][0] for part in parts) for c in ("n", "scored", "loss", "bits")}
        mean = {c: total[c] / total["scored"] if total["scored"] else None for c in ("loss", "bits")}
        return {"pairing": row["pairing"], "run_id": row["run_id"], "n": total["n"], **mean}

    columns = embedded.select(*SPACE, "n_samples", "ts", "es")
    return map_spaces(columns, run, f"{layout(columns, *SPACE)}, n bigint, loss double, bits double")


BATCH_LOSS = "pairing string, run_id int, n bigint, scored bigint, loss double, bits double"


def _batch_loss(row: dict, e: np.ndarray, pos: np.ndarray, temperature: float, alike: np.ndarray | None = None) -> dict:
    """Summed loss of a batch; a reference that is alone has no negatives and is counted without a loss.

    ``alike`` numbers the vectors, equal ones the same: each then meets each other one once.
    """
    found = {"pairing": row["pairing"], "run_id": row["run_id"], "n": [len(e)]}
    if len(e) < 2:
        return {**found, "scored": [0], "loss": [0.0], "bits": [0.0]}
    near = (e * pos).sum(axis=1) / temperature
    first = which = np.arange(len(e))
    copies = np.ones(len(e))
    if alike is not None:
        _, first, which, copies = np.unique(alike, return_index=True, return_inverse=True, return_counts=True)
    far = e[first] @ e[first].T
    np.exp(np.divide(far, temperature, out=far), out=far)
    own = np.where(copies > 1, far.diagonal(), 0.0) * (copies - 1)
    np.fill_diagonal(far, 0.0)
    value = np.log(far @ copies + own)[which] - near
    return {**found, "scored": [len(e)], "loss": [value.sum()], "bits": [((np.log(len(e) - 1) - value) / np.log(2)).sum()]}


def _goodness(per_batch: DataFrame) -> DataFrame:
    """Means over the references that have negatives; ``n`` counts all."""
    return per_batch.groupBy(*SPACE).agg(
        F.sum("n").alias("n"),
        F.try_divide(F.sum("loss"), F.sum("scored")).alias("loss"),
        F.try_divide(F.sum("bits"), F.sum("scored")).alias("bits"),
    )


def infonce_labelled(embedded: DataFrame, recordings: DataFrame, temperature: float = TEMPERATURE, batch: int = BATCH) -> DataFrame:
    """Goodness of fit of a labelled embedding: ``pairing, run_id, n, loss, bits``.

    ``embedded`` has ``pairing, run_id, t, e, y``; rows without a label are no references.  Which batch a sample is in
    depends on a multiple of its time, not on its place in the recording, so batches have ``batch`` samples on average and
    neighbours in time or channel are in different ones.  The positive of a reference comes from its own batch: the sample
    whose label is nearest to the reference's, of several the next one in time (from the last on to the first).  The rest
    of the batch are the negatives.  Every reference is counted.
    """
    whole = embedded.filter("y is not null").withColumn("e", unit(F.col("e")))
    counts = recordings.select("pairing", F.greatest(F.floor(F.col("n_samples") / batch), F.lit(1)).cast("bigint").alias("_n"))
    mixed = (F.col("t") % LABEL_MODULUS) * LABEL_FACTOR % LABEL_MODULUS
    batched = attach(whole, counts, "pairing", bound=recordings).withColumn("batch", F.pmod(mixed, F.col("_n")))
    rows = batched.select(*SPACE, "batch", "t", F.concat("e", F.array(F.col("y").cast("double"))).alias("x"))

    def loss(row: dict) -> dict:
        x = matrix(row)
        e, y = x[:, :-1], x[:, -1]
        n = len(e)
        pos = e
        if n > 1:
            apart = np.abs(y[:, None] - y[None, :])
            np.fill_diagonal(apart, np.inf)
            ahead = (np.arange(n)[None, :] - np.arange(n)[:, None]) % n
            pos = e[np.where(apart == apart.min(axis=1, keepdims=True), ahead, n + 1).argmin(axis=1)]
        return _batch_loss(row, e, pos, temperature)

    return _goodness(map_chunks(pack(rows, SPACE, "batch"), loss, BATCH_LOSS))


def bits(loss: Column, n: Column | int = BATCH) -> Column:
    """Goodness of fit of a loss with ``n`` negatives."""
    return (F.log(F.lit(n).cast("double") if isinstance(n, int) else n.cast("double")) - loss) / F.log(F.lit(2.0))


def fit_history(history: DataFrame, n: int = BATCH) -> DataFrame:
    """Add ``bits`` to the loss of every iteration."""
    return history.withColumn("bits", bits(F.col("loss"), n))


def history_summary(history: DataFrame) -> DataFrame:
    """Best and last goodness of fit of each run."""
    return history.groupBy(*SPACE).agg(
        F.count(F.lit(1)).alias("n_iter"),
        F.max("bits").alias("best_bits"),
        F.min(F.struct(-F.col("bits"), F.col("iter"))).getField("iter").alias("best_iter"),
        F.max_by("bits", "iter").alias("last_bits"),
    )


def successful_runs(embedded: DataFrame, status: DataFrame) -> DataFrame:
    """Only the runs that ended well."""
    if is_whole(embedded):
        # Their keys are read alone; runs that did not end well are few, and mostly none.
        others = settle(embedded.select(*SPACE).dropna().join(status.filter("ok").select(*SPACE), SPACE, "left_anti").distinct())
        known = embedded.dropna(subset=SPACE)
        return attach_whole(known, others, SPACE, "left_anti") if row_count(others) else known
    return attach(embedded, status.filter("ok").select(*SPACE).distinct(), SPACE, "left_semi", bound=status)


def run_status(expected: DataFrame, embedded: DataFrame) -> DataFrame:
    """``pairing, run_id, ok``: an expected run is ok if it left finite embeddings only."""
    finite = F.forall("e", lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))
    if is_whole(embedded):
        columns = embedded.select(*SPACE, "es")
        fine = lambda row: {**{k: row[k] for k in SPACE}, "fine": bool(np.isfinite(row["es"]).all())}
        embedded, finite = map_spaces(columns, fine, f"{layout(columns, *SPACE)}, fine boolean"), F.col("fine")
    seen = embedded.groupBy(*SPACE).agg(F.min(finite.cast("int")).alias("_fine"))
    return expected.join(seen, SPACE, "left").select(*SPACE, (F.coalesce("_fine", F.lit(0)) == 1).alias("ok"))


def run_consistency(embedded: DataFrame, block: int = CHUNK) -> DataFrame:
    """``pairing, run_i, run_j, n, r2, r2_weighted``: how well run i explains run j by a linear map.

    All runs of a stretch of time form one chunk, so a single shuffle and one pass of sums serve every pair of
    runs.  ``r2`` averages the output dimensions equally, ``r2_weighted`` by their variance.
    """
    rows = embedded.select("pairing", "run_id", "t", "e").withColumn("block", block_of("t", block))
    chunks = pack(rows, ["pairing"], value="e", extra=["run_id"])

    def sums(row: dict):
        e, t, r = matrix(row), row["ts"], row["run_id"]
        parts = {int(k): (t[r == k], e[r == k]) for k in np.unique(r)}
        ids = sorted(parts)
        for a, i in enumerate(ids):
            for j in ids[a + 1 :]:
                _, at, bt = np.intersect1d(parts[i][0], parts[j][0], assume_unique=True, return_indices=True)
                z = np.hstack([parts[i][1][at], parts[j][1][bt]])
                yield (row["pairing"], i, j), np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])

    def fit(sxx: np.ndarray, sxy: np.ndarray, syy: np.ndarray) -> tuple[float, float]:
        explained = (sxy * (np.linalg.pinv(sxx, hermitian=True) @ sxy)).sum(axis=0)
        total = np.diag(syy)
        moving = total > 0
        if not moving.any():
            return np.nan, np.nan
        return float((explained[moving] / total[moving]).mean()), float(explained[moving].sum() / total[moving].sum())

    def solve(row: dict) -> dict | None:
        n, _, cov = split_moments(row["v"])
        if n < 2:
            return None
        d = len(cov) // 2
        there = fit(cov[:d, :d], cov[:d, d:], cov[d:, d:])
        back = fit(cov[d:, d:], cov[d:, :d], cov[:d, :d])
        i, j = row["run_a"], row["run_b"]
        return {
            "pairing": row["pairing"], "run_i": [i, j], "run_j": [j, i], "n": [int(n)] * 2,
            "r2": [there[0], back[0]], "r2_weighted": [there[1], back[1]],
        }

    moved = summed(chunks, ["pairing", "run_a", "run_b"], sums, "pairing string, run_a int, run_b int")
    solved = map_chunks(moved, solve, "pairing string, run_i int, run_j int, n bigint, r2 double, r2_weighted double")
    return solved.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in ("r2", "r2_weighted")})


def variability(consistency: DataFrame, pairings: DataFrame | None = None, value: str = "r2") -> DataFrame:
    """``pairing, mean_consistency, variability``; NULL for listed pairings with fewer than two runs."""
    means = consistency.groupBy("pairing").agg(F.avg(value).alias("mean_consistency"))
    if pairings is not None:
        means = pairings.select("pairing").distinct().join(means, "pairing", "left")
    return means.withColumn("variability", 1 - F.col("mean_consistency"))


def class_distance(embedded: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Mean cosine distance of pairs within a class (``intra``) and across classes (``inter``).

    Sums of unit vectors per class hold all the pairs: the squared length of a sum is the sum over its pairs.
    """
    whole = embedded.select(*keys, F.col(label).alias("_y"), unit(F.col("e")).alias("e"))
    per_element = whole.select(*keys, "_y", F.posexplode("e").alias("_i", "v")).groupBy(*keys, "_y", "_i").agg(
        F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("own"), F.count(F.lit(1)).alias("n")
    )
    squared = F.col("s") * F.col("s")
    over_classes = per_element.groupBy(*keys, "_i").agg(
        F.sum("s").alias("s"), F.sum(squared).alias("sq"), F.sum("own").alias("own"),
        F.sum("n").cast("double").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
    )
    totals = over_classes.groupBy(*keys).agg(
        F.sum(squared).alias("all_sq"), F.sum("sq").alias("sq"), F.sum("own").alias("own"), F.max("n").alias("n"), F.max("n2").alias("n2")
    )
    intra = 1 - F.try_divide(F.col("sq") - F.col("own"), F.col("n2") - F.col("n"))
    inter = 1 - F.try_divide(F.col("all_sq") - F.col("sq"), F.col("n") * F.col("n") - F.col("n2"))
    return totals.select(*keys, intra.alias("intra"), inter.alias("inter"))


def split_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    if is_whole(rows):
        columns = rows.select(*keys, "n_train", "ts")

        def count(row: dict) -> dict:
            n = int((row["ts"] < row["n_train"]).sum())
            return {**{k: row[k] for k in keys}, "n_train": n, "n_val": len(row["ts"]) - n}

        return map_spaces(columns, count, f"{layout(columns, *keys)}, n_train bigint, n_val bigint")
    return rows.groupBy(*keys).agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_val")
    )


def l1_regression(rows: DataFrame, alpha: float = 1.0, rounds: int = 1000, tolerance: float = 1e-10, block: int = CHUNK) -> DataFrame:
    """L1-penalised linear regression per (pairing, run): ``coef, intercept``.

    Minimises ``|y - Xw - b|^2 / 2n + alpha * |w|_1`` on the rows of split 'train'.  One aggregation collects the
    moments of (e, y); the descent runs on those few numbers.
    """
    train = rows.filter("split = 'train' and y is not null")
    joined = train.select(*SPACE, "t", F.concat("e", F.array(F.col("y").cast("double"))).alias("x"))
    chunks = pack(joined.withColumn("block", block_of("t", block)), SPACE)

    def sums(row: dict):
        x = matrix(row)
        yield (row["pairing"], row["run_id"]), np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    def descend(row: dict) -> dict:
        _, mean, cov = split_moments(row["v"])
        gram, target = cov[:-1, :-1], cov[:-1, -1]
        w = np.zeros(len(target))
        for _ in range(rounds):
            before = w.copy()
            for k in range(len(w)):
                if gram[k, k] <= 0:
                    continue
                rest = target[k] - gram[k] @ w + gram[k, k] * w[k]
                w[k] = np.sign(rest) * max(abs(rest) - alpha, 0.0) / gram[k, k]
            if np.abs(w - before).max() < tolerance:
                break
        return {"pairing": [row["pairing"]], "run_id": [row["run_id"]], "coef": w[None], "intercept": [mean[-1] - w @ mean[:-1]]}

    moved = summed(chunks, SPACE, sums, "pairing string, run_id int")
    return map_chunks(moved, descend, "pairing string, run_id int, coef array<double>, intercept double")


def predict_linear(rows: DataFrame, model: DataFrame) -> DataFrame:
    return attach(rows, settle(model), SPACE).withColumn("pred", dot(F.col("e"), F.col("coef")) + F.col("intercept")).drop("coef", "intercept")


def decode_continuous(rows: DataFrame, traits: DataFrame | None, alpha: float = 1.0) -> DataFrame:
    """``pairing, run_id, cont_r2`` on the test rows; NULL where a pairing has no continuous target."""
    every = rows.select(*SPACE).distinct()
    if traits is None:
        return every.withColumn("cont_r2", F.lit(None).cast("double"))
    known = rows.join(traits.select("pairing", "t", "y"), ["pairing", "t"])
    tested = predict_linear(known.filter("split = 'test'"), l1_regression(known, alpha))
    return every.join(r_squared(tested, SPACE).select(*SPACE, F.col("r2").alias("cont_r2")), SPACE, "left")
