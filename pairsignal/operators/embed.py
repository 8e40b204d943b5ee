"""Low-dimensional embeddings of stacked pairs: context windows, positive pairs, linear contrastive projection."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsignal.functions.chunks import CHUNK, is_whole, layout, map_chunks, map_spaces, matrix, pack, summed
from pairsignal.functions.vectors import unit, unit_rows
from pairsignal.operators.blocks import BLOCK, attach, block_of, largest, spread_join, with_halo
from pairsignal.session import settle

# Fixed values of the embedding.
OFFSET = 10
DIMENSIONS = 3
FIELD_LEFT, FIELD_RIGHT = 5, 5
RIDGE = 1e-9
BASE, WANTED = -1, -2  # parts of the moment sums
DRAW_MODULUS, DRAW_FACTOR = 2**31 - 1, 40503  # which time step a sample draws, in whole numbers


def receptive_field(samples: DataFrame, key: str = "rec_id", left: int = FIELD_LEFT, right: int = FIELD_RIGHT,
                    edges: str = "drop", block: int = BLOCK) -> DataFrame:
    """Join each sample with its neighbours: ``x`` becomes the values at t-left .. t+right-1.

    ``edges='drop'`` leaves out times without a full neighbourhood, 'replicate' repeats the first or last sample.
    Whole chunks of one feature get the extent of the windows only; ``_fields`` cuts them where they are read.
    """
    if is_whole(samples):
        if edges == "drop":
            raise ValueError("whole chunks keep every sample: edges='replicate'")
        return samples.withColumns({"left": F.lit(left), "right": F.lit(right)})
    spread = with_halo(samples.select(key, "t", "x"), block, left, right - 1)
    order = Window.partitionBy(key, "block").orderBy("t")
    near = spread.withColumn("_f", F.collect_list("x").over(order.rowsBetween(-left, right - 1)))
    near = near.withColumn("_before", F.count(F.lit(1)).over(order.rowsBetween(-left, -1)))
    core = near.filter("core")
    if edges == "drop":
        whole = core.filter(F.size("_f") == left + right)
        return whole.select(key, "t", F.flatten("_f").alias("x"))
    lead = F.array_repeat(F.element_at("_f", 1), (F.lit(left) - F.col("_before")).cast("int"))
    tail = F.array_repeat(F.element_at("_f", -1), F.lit(left + right) - F.size("_f") - (F.lit(left) - F.col("_before")).cast("int"))
    return core.select(key, "t", F.flatten(F.concat(lead, "_f", tail)).alias("x"))


def _fields(row: dict) -> np.ndarray:
    """The samples of a whole chunk, each with its neighbours if it has windows."""
    x = matrix(row)
    if "left" not in row:
        return x
    return x[np.clip(np.arange(len(x))[:, None] + np.arange(-row["left"], row["right"]), 0, len(x) - 1)].reshape(len(x), -1)


def positive_pairs(embedded: DataFrame, keys: Sequence[str] = ("pairing", "run_id"), offset: int = OFFSET,
                   block: int = BLOCK) -> DataFrame:
    """Each sample with the one ``offset`` samples later: adds ``t_pos, e_pos``; the last ``offset`` have none."""
    spread = with_halo(embedded, block, 0, offset)
    order = Window.partitionBy(*keys, "block").orderBy("t")
    led = spread.withColumns({"t_pos": F.lead("t", offset).over(order), "e_pos": F.lead("e", offset).over(order)})
    return led.filter(F.col("core") & (F.col("t_pos") == F.col("t") + offset)).select(*embedded.columns, "t_pos", "e_pos")


def nearest_label_pairs(labels: DataFrame, ends: DataFrame, key: str = "pairing", offset: int = OFFSET, block: int = BLOCK) -> DataFrame:
    """Positive pairs by label difference: ``key, t, target, t_pos, y_pos``.

    ``labels`` is ``key, t, y``, ``ends`` has a row per key.  Each sample draws, by its time, a time step's change
    ``y[s+offset] - y[s]`` and is paired with the sample whose ``y`` is nearest to ``y + change`` (ties: smaller y, then smaller t).
    """
    order = Window.partitionBy(key, "block").orderBy("t")
    spread = with_halo(labels.select(key, "t", "y"), block, 0, offset)
    steps = spread.withColumns({"_t2": F.lead("t", offset).over(order), "_y2": F.lead("y", offset).over(order)}).filter(
        F.col("core") & (F.col("_t2") == F.col("t") + offset)
    )
    changes = steps.select(key, F.col("t").alias("_s"), (F.col("_y2") - F.col("y")).alias("_change"))
    count = labels.groupBy(key).agg((F.max("t") + 1 - offset).alias("_m"))
    drawn = attach(labels, count, key, bound=ends).filter("_m > 0").withColumn("_s", F.pmod((F.col("t") % DRAW_MODULUS) * DRAW_FACTOR, F.col("_m")))
    wanted = drawn.join(changes, [key, "_s"]).select(key, "t", (F.col("y") + F.col("_change")).alias("target"))
    return nearest(wanted, labels, ends, key)


def nearest(wanted: DataFrame, labels: DataFrame, keys_table: DataFrame, key: str, pieces: int = 1024) -> DataFrame:
    """For each ``target`` the row of ``labels`` with the nearest ``y``, by sorting both within value ranges.

    Equal labels and equal targets are collapsed first, so a constant label is one row.  The ranges follow the
    quantiles of both.  Each range is one window; what it cannot see (the next value below and above it) comes from
    a table with one row per range.
    """
    distinct = labels.groupBy(key, "y").agg(F.min("t").alias("_t"))
    asking = wanted.select(key, "target").distinct()
    values = distinct.select(key, F.col("y").alias("_v")).unionByName(asking.select(key, F.col("target").alias("_v")))
    marks = [i / pieces for i in range(pieces + 1)]
    ends = values.groupBy(key).agg(F.sort_array(F.array_distinct(F.percentile_approx("_v", marks, pieces * 4))).alias("_cuts"))

    def piece(df: DataFrame, value: str) -> DataFrame:
        cut = attach(df, ends, key, bound=keys_table, numbers=pieces, spread=value)
        return cut.withColumn("piece", _pieces_below(F.col("_cuts"), F.col(value))).drop("_cuts")

    known = piece(distinct, "y").select(key, "piece", F.col("y").alias("v"), F.lit(0).alias("kind"), F.struct(F.col("y"), F.col("_t").alias("t")).alias("hit"))
    asked = piece(asking, "target").select(key, "piece", F.col("target").alias("v"), F.lit(1).alias("kind"), F.lit(None).cast(known.schema["hit"].dataType).alias("hit"))
    per_piece = known.groupBy(key, "piece").agg(F.min("hit").alias("_lo"), F.max("hit").alias("_hi"))
    every = known.select(key, "piece").unionByName(asked.select(key, "piece")).distinct().join(per_piece, [key, "piece"], "left")
    along = Window.partitionBy(key).orderBy("piece")
    outside = every.select(
        key, "piece",
        F.last("_hi", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_under"),
        F.first("_lo", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_over"),
    )
    inside = Window.partitionBy(key, "piece").orderBy("v", "kind")
    seen = known.unionByName(asked).withColumns({
        "below": F.last("hit", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        "above": F.first("hit", True).over(inside.rowsBetween(0, Window.unboundedFollowing)),
    }).filter("kind = 1").join(outside, [key, "piece"])
    below, above = F.coalesce("below", "_under"), F.coalesce("above", "_over")
    pick = F.when(above.isNull() | (F.col("v") - below["y"] <= above["y"] - F.col("v")), below).otherwise(above)
    found = seen.select(key, F.col("v").alias("target"), pick.alias("_p")).select(
        key, "target", F.col("_p.t").alias("t_pos"), F.col("_p.y").alias("y_pos")
    )
    return spread_join(wanted, found, [key, "target"], "t").select(key, "t", "target", "t_pos", "y_pos")


def _pieces_below(cuts: Column, value: Column) -> Column:
    """How many cut values lie below ``value``."""
    return F.size(F.filter(cuts, lambda c: c < value))


def _mix(t: np.ndarray, run: int) -> np.ndarray:
    """A uniform number in [0, 1) per (run, t), the same on every machine."""
    with np.errstate(over="ignore"):
        z = t.astype(np.uint64) + np.uint64(run + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def _directions(total: np.ndarray, wanted: np.ndarray, d: int) -> np.ndarray:
    """Top generalized eigenvectors of ``wanted`` against ``total``, with a fixed sign."""
    values, vectors = np.linalg.eigh(total)
    keep = values > max(values.max(), 0) * RIDGE
    white = vectors[:, keep] / np.sqrt(values[keep])
    inner = white.T @ ((wanted + wanted.T) / 2) @ white
    contrast, rotation = np.linalg.eigh(inner)
    # A direction without contrast (a correlation, at most about 1) would be noise of unit length: it stays zero.
    rotation = rotation * (np.abs(contrast) > np.abs(contrast).max(initial=1) * RIDGE)
    w = (white @ rotation[:, ::-1][:, :d]).T
    signs = np.sign(w[np.arange(len(w)), np.abs(w).argmax(axis=1)]) if w.size else np.ones(len(w))
    out = np.zeros((d, total.shape[0]))
    out[: len(w)] = w * signs[:, None]
    return out


def fit_linear(samples: DataFrame, recordings: DataFrame, mode: str = "time", runs: int = 5, offset: int = OFFSET,
               dimensions: int = DIMENSIONS, block: int = CHUNK) -> DataFrame:
    """Projections that make positive pairs most similar, for all pairings and runs in one pass over the samples.

    ``samples`` has ``pairing, t, x`` (and ``y`` for the modes 'label' and 'delta').  In mode 'time' the partner of a sample
    is the one ``offset`` later, in mode 'label' any sample of its label, in mode 'delta' the sample whose label is nearest to
    its own changed by that of a drawn time step (``nearest_label_pairs``).  Every run sees all samples, each with a weight
    drawn by hash (exponential, so runs differ as resampled data would).  Result: ``pairing, run_id, out_idx, w, b``.
    """
    ddl = "pairing string, run_id int, part bigint"
    if mode == "delta":
        chunks = pack(partnered(samples, recordings, offset).withColumn("block", block_of("t", block)), ["pairing"])
    else:
        extra = ["y"] if mode == "label" else []
        spread = with_halo(samples.select("pairing", "t", "x", *extra), block, 0, offset if mode == "time" else 0)
        chunks = pack(spread, ["pairing"], extra=["core", *extra])

    def run(row: dict):
        x, t = matrix(row), row["ts"]
        core = None if mode == "delta" else np.asarray(row["core"], dtype=bool)
        labels = _labels(np.asarray(row["y"][core], float)) if mode == "label" else None
        for r in range(runs):
            for name, v in _sums(x, t, core, labels, mode, r, offset):
                yield (row["pairing"], r, name), v

    def scatter(row: dict):
        yield (row["pairing"], row["run_id"], WANTED), _scatter(row["v"])

    sums = summed(chunks, ["pairing", "run_id", "part"], run, ddl)
    if mode == "label":
        sums = settle(sums)
        per_label = summed(sums.filter(F.col("part") != BASE), ["pairing", "run_id", "part"], scatter, ddl)
        sums = sums.filter(F.col("part") == BASE).unionByName(per_label)
    part = lambda which: F.any_value(F.when(F.col("part") == which, F.col("v")), F.lit(True))
    gathered = sums.groupBy("pairing", "run_id").agg(part(BASE).alias("base"), part(WANTED).alias("other"))

    def solve(row: dict) -> dict:
        w, b = _solved(row["base"], row["other"], mode, dimensions)
        return {
            "pairing": row["pairing"], "run_id": [row["run_id"]] * dimensions, "out_idx": np.arange(dimensions, dtype=np.int32),
            "w": w, "b": b,
        }

    return map_chunks(gathered, solve, "pairing string, run_id int, out_idx int, w array<double>, b double")


def _moments(weight: np.ndarray, x: np.ndarray) -> np.ndarray:
    weighted = x * weight[:, None]
    return np.concatenate([[weight.sum()], weighted.sum(axis=0), (weighted.T @ x).ravel()])


def _across(weight: np.ndarray, x: np.ndarray, partner: np.ndarray) -> np.ndarray:
    weighted = x * weight[:, None]
    return np.concatenate([[weight.sum()], weighted.sum(axis=0), weight @ partner, (weighted.T @ partner).ravel()])


def _labels(y: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each label's bits and rows.  By the bits fractions stay apart, and no label is BASE or WANTED."""
    y = y + 0.0
    return [(int(label.view(np.int64)), np.flatnonzero(y == label)) for label in np.unique(y)]


def _sums(x: np.ndarray, t: np.ndarray, core: np.ndarray | slice | None, labels: list[tuple[int, np.ndarray]] | None, mode: str, run: int, offset: int):
    """The (part, sums) of a chunk that a run is fitted from; in mode 'label' those of each label are apart."""
    weight = -np.log1p(-_mix(t, run))
    if mode == "delta":
        own, partner = x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]
        yield BASE, _moments(weight, own)
        yield WANTED, _across(weight, own, partner)
        return
    own, weight = x[core], weight[core]
    yield BASE, _moments(weight, own)
    if mode == "time":
        at = np.searchsorted(t, t[core] + offset)
        found = (at < len(t)) & (t[np.minimum(at, len(t) - 1)] == t[core] + offset)
        yield WANTED, _across(weight[found], own[found], x[at[found]])
        return
    for name, part in labels:
        yield name, np.concatenate([[weight[part].sum()], weight[part] @ own[part]])


def _scatter(sums: np.ndarray) -> np.ndarray:
    """A label's share of the sum over its pairs: the outer product of its sum by its weight."""
    weight, total = sums[0], sums[1:]
    return (np.outer(total, total) / (weight or 1.0)).ravel()


def _solved(base: np.ndarray, other: np.ndarray, mode: str, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The projection (one row per dimension) and its offsets, out of the sums of all chunks."""
    n, c = base[0], int(round((-1 + np.sqrt(1 + 4 * (len(base) - 1))) / 2))
    mean = base[1 : 1 + c] / n
    total = base[1 + c :].reshape(c, c) / n - np.outer(mean, mean)
    o = other
    if mode == "label":
        wanted = o.reshape(c, c) / n - np.outer(mean, mean)
    else:
        m = o[0] or 1.0
        wanted = o[1 + 2 * c :].reshape(c, c) / m - np.outer(o[1 : 1 + c], o[1 + c : 1 + 2 * c]) / m**2
    w = _directions(total, wanted, dimensions)
    return w, -(w @ mean)


def partnered(samples: DataFrame, recordings: DataFrame, offset: int = OFFSET) -> DataFrame:
    """Each sample beside its partner by label difference: ``pairing, t, x`` with both vectors one after the other.

    A sample may be the partner of very many, with a constant label of all; ``spread_join`` splits such a key.
    """
    found = settle(nearest_label_pairs(samples.select("pairing", "t", "y"), recordings, "pairing", offset).select("pairing", "t", "t_pos"))
    both = found.join(samples.select("pairing", "t", "x"), ["pairing", "t"])
    partner = samples.select("pairing", F.col("t").alias("t_pos"), F.col("x").alias("x_pos"))
    return spread_join(both, partner, ["pairing", "t_pos"], "t").select("pairing", "t", F.concat("x", "x_pos").alias("x"))


def transform(samples: DataFrame, projection: DataFrame, block: int = CHUNK) -> DataFrame:
    """Unit-length embeddings ``pairing, run_id, t, e`` of every sample under every run's projection."""
    packed = projection.groupBy("pairing").agg(F.sort_array(F.collect_list(F.struct("run_id", "out_idx", "w", "b"))).alias("_p"))
    per_pairing = settle(packed.select(
        "pairing", F.col("_p.run_id").alias("runs"), F.flatten("_p.w").alias("ws"), F.col("_p.b").alias("bs")
    ).withColumn("width", F.size("ws")))
    widest = int(largest(per_pairing, "width") or 1)
    chunks = attach(pack(samples.withColumn("block", block_of("t", block)), ["pairing"]), per_pairing, "pairing", numbers=2 * widest, spread="block")

    def run(row: dict) -> dict:
        z = matrix(row) @ row["ws"].reshape(len(row["runs"]), -1).T + row["bs"]
        ids = np.unique(row["runs"])
        e = np.concatenate([z[:, row["runs"] == r] for r in ids])
        return {
            "pairing": row["pairing"], "run_id": np.repeat(ids, len(z)).astype(np.int32), "t": np.tile(row["ts"], len(ids)), "e": e,
        }

    raw = map_chunks(chunks, run, "pairing string, run_id int, t bigint, e array<double>")
    return raw.withColumn("e", unit(F.col("e")))


def embed_linear(samples: DataFrame, recordings: DataFrame, mode: str = "time", runs: int = 5, fit_on: str = "train",
                 **options) -> DataFrame:
    """Fit on the training part of each pairing (or on 'all') and embed every sample.

    ``recordings``: ``pairing, n_samples, n_train``; whole chunks bring these themselves, and ``label`` for the mode of that name.
    """
    if is_whole(samples):
        return _embed_whole(samples, mode, runs, fit_on, **options)
    fitted = samples
    if fit_on == "train":
        fitted = attach(samples, recordings.select("pairing", "n_train"), "pairing", bound=recordings).filter("t < n_train").drop("n_train")
    projection = fit_linear(fitted, recordings, mode, runs, **options)
    return transform(samples, projection)


def _embed_whole(samples: DataFrame, mode: str, runs: int, fit_on: str, offset: int = OFFSET, dimensions: int = DIMENSIONS) -> DataFrame:
    """``fit_linear`` and ``transform`` of whole chunks: ``pairing, run_id, n_samples, n_train, ts, es, label``."""
    if mode not in ("time", "label"):
        raise ValueError(f"whole chunks are not fitted by {mode}")
    kept = [c for c in ("pairing", "n_samples", "n_train", "ts", "label") if c in samples.columns]

    def run(row: dict) -> dict | None:
        x, t = _fields(row), row["ts"]
        fit = t < row["n_train"] if fit_on == "train" else np.ones(len(t), bool)
        if not fit.any():
            return None
        xf, tf = x[fit], t[fit]
        labels = _labels(row["label"][fit]) if mode == "label" else None
        made = []
        for r in range(runs):
            sums = dict(_sums(xf, tf, slice(None), labels, mode, r, offset))
            base = sums.pop(BASE)
            made.append(_solved(base, sum(map(_scatter, sums.values())) if mode == "label" else sums[WANTED], mode, dimensions))
        z = x @ np.concatenate([w for w, _ in made]).T + np.concatenate([b for _, b in made])
        es = [unit_rows(z[:, r * dimensions : (r + 1) * dimensions]).ravel() for r in range(runs)]
        return {"run_id": np.arange(runs, dtype=np.int32), "es": es, **{c: [row[c]] * runs for c in kept}}

    return map_spaces(samples, run, f"run_id int, {layout(samples, *kept)}, es binary")
