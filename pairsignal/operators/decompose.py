"""Independent components of many recordings at once.

A recording of one chunk is solved in the task that holds the chunk.  For longer ones every step over samples is one
aggregation keyed by recording; only matrices of channel size are solved, one per recording, inside tasks.  Their state
table is written each round, so its lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsignal.functions.chunks import CHUNK, map_chunks, matrix, summed
from pairsignal.operators.blocks import HEAVY_CHUNKS, attach, channel_count, row_count
from pairsignal.operators.remix import matrix_per_key, pack_blocks
from pairsignal.session import settle

# Fixed values of the fit.
SEED = 97
COMPONENTS = 15
MAX_ROUNDS = 200
TOLERANCE = 1e-4
RANK_FLOOR = 1e-10  # eigenvalues below this share of the largest count as zero

STATE = "rec_id string, mean array<double>, k array<double>, w array<double>, done boolean"


def moments(chunks: DataFrame) -> DataFrame:
    """``rec_id, v`` with count, channel sums and the Gram matrix."""

    def run(row: dict):
        x = matrix(row)
        yield (row["rec_id"],), np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    return summed(chunks, ["rec_id"], run, "rec_id string")


def split_moments(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, mean and covariance out of a moment vector 1 + C + C*C."""
    c = int(round((-1 + np.sqrt(1 + 4 * (len(v) - 1))) / 2))
    n, mean = v[0], v[1 : 1 + c] / v[0]
    return n, mean, v[1 + c :].reshape(c, c) / n - np.outer(mean, mean)


def _orthonormal(w: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(w)
    return u @ vt


def fit_components(samples: DataFrame, recordings: DataFrame, n_components: int = COMPONENTS, seed: int = SEED,
                   max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE, block: int = CHUNK) -> DataFrame:
    """Symmetric fixed-point search with the tanh contrast.

    Result per recording: ``mean`` (C), ``k`` (whitening, n x C), ``w`` (rotation, n x n), ``done``.
    A recording of lower rank gets as many components as its rank.
    """
    # Every round reads the chunks, so they are written once.
    chunks = settle(pack_blocks(samples, ["rec_id"], block))
    several = settle(chunks.groupBy("rec_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("rec_id"))
    # A recording that is one chunk is solved where the chunk is, by the same steps.
    whole = attach(chunks, several, "rec_id", "left_anti", spread="block")
    state = settle(map_chunks(whole, lambda row: _solved(row, n_components, seed, max_rounds, tolerance), STATE))
    if row_count(several):
        long = settle(attach(chunks, several, "rec_id", "left_semi", spread="block"))
        state = settle(state.unionByName(_fit_long(long, recordings, n_components, seed, max_rounds, tolerance)))
    unfinished = state.filter(~F.col("done")).count()
    if unfinished:
        warnings.warn(f"the components of {unfinished} recordings have not converged in {max_rounds} rounds", stacklevel=2)
    return state


def _start(v: np.ndarray, n_components: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Mean, whitening and first rotation out of a moment vector."""
    _, mean, cov = split_moments(v)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    order = order[values[order] > RANK_FLOOR * max(values[order[0]], 0)][:n_components]
    if not len(order):
        return None
    k = (vectors[:, order] / np.sqrt(values[order])).T
    return mean, k, _orthonormal(np.random.default_rng(seed).standard_normal((len(order), len(order))))


def _contrast(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A chunk's sums of a round: its size, the slopes and the products."""
    g = np.tanh(z @ w.T)
    return np.concatenate([[len(z)], (1 - g**2).sum(axis=0), (g.T @ z).ravel()])


def _step(v: np.ndarray, w: np.ndarray, tolerance: float) -> tuple[np.ndarray, bool]:
    """The next rotation, and whether it hardly differs."""
    n = len(w)
    new = _orthonormal(v[1 + n :].reshape(n, n) / v[0] - np.diag(v[1 : 1 + n] / v[0]) @ w)
    moved = np.max(np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1))
    return new, bool(moved < tolerance)


def _solved(row: dict, n_components: int, seed: int, max_rounds: int, tolerance: float) -> dict | None:
    x = matrix(row)
    begun = _start(np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()]), n_components, seed)
    if begun is None:
        return None
    mean, k, w = begun
    z, done = (x - mean) @ k.T, False
    for _ in range(max_rounds):
        w, done = _step(_contrast(z, w), w, tolerance)
        if done:
            break
    return {"rec_id": [row["rec_id"]], "mean": mean[None], "k": k.reshape(1, -1), "w": w.reshape(1, -1), "done": done}


def _fit_long(chunks: DataFrame, recordings: DataFrame, n_components: int, seed: int, max_rounds: int, tolerance: float) -> DataFrame:
    """The state of recordings of several chunks: a round is one aggregation for all of them."""

    def start(row: dict) -> dict | None:
        begun = _start(row["v"], n_components, seed)
        if begun is None:
            return None
        mean, k, w = begun
        return {"rec_id": [row["rec_id"]], "mean": mean[None], "k": k.reshape(1, -1), "w": w.reshape(1, -1), "done": False}

    state = settle(map_chunks(moments(chunks), start, STATE))

    def contrast(row: dict):
        n = int(round(np.sqrt(len(row["w"]))))
        z = (matrix(row) - row["mean"]) @ row["k"].reshape(n, -1).T
        yield (row["rec_id"],), _contrast(z, row["w"].reshape(n, n))

    def step(row: dict) -> dict:
        n = int(round(np.sqrt(len(row["w"]))))
        new, done = _step(row["v"], row["w"].reshape(n, n), tolerance)
        return {"rec_id": [row["rec_id"]], "mean": row["mean"][None], "k": row["k"][None], "w": new.reshape(1, -1), "done": done}

    numbers = channel_count(recordings) * (2 * n_components + 1)
    for _ in range(max_rounds):
        open_state = state.filter(~F.col("done"))
        if open_state.isEmpty():
            break
        sums = summed(attach(chunks, open_state.drop("done"), "rec_id", bound=recordings, numbers=numbers, spread="block"), ["rec_id"], contrast, "rec_id string")
        stepped = map_chunks(open_state.join(sums, "rec_id"), step, STATE)
        state = settle(state.filter("done").unionByName(stepped))
    return state


def unmixing(state: DataFrame) -> DataFrame:
    """``rec_id, out_idx, w``: rows that turn centred samples into components."""

    def run(row: dict) -> dict:
        n = int(round(np.sqrt(len(row["w"]))))
        u = row["w"].reshape(n, n) @ row["k"].reshape(n, -1)
        return {"rec_id": row["rec_id"], "out_idx": np.arange(n, dtype=np.int32), "w": u}

    return map_chunks(state, run, "rec_id string, out_idx int, w array<double>")


def cleaning_matrix(state: DataFrame, excluded: DataFrame) -> DataFrame:
    """``rec_id, out_idx, w, b``: remove the listed components (``rec_id, comps array<bigint>``), keep all else."""
    chosen = state.join(excluded.select("rec_id", "comps"), "rec_id")

    def run(row: dict) -> dict:
        n = int(round(np.sqrt(len(row["w"]))))
        k, w = row["k"].reshape(n, -1), row["w"].reshape(n, n)
        drop = np.unique(row["comps"][(row["comps"] >= 0) & (row["comps"] < n)])
        mixing = np.linalg.pinv(k) @ w.T
        m = np.eye(k.shape[1]) - mixing[:, drop] @ (w @ k)[drop]
        return {"rec_id": row["rec_id"], "out_idx": np.arange(len(m), dtype=np.int32), "w": m, "b": row["mean"] - m @ row["mean"]}

    return map_chunks(chosen, run, "rec_id string, out_idx int, w array<double>, b double")


def remove_components(samples: DataFrame, state: DataFrame, excluded: DataFrame, recordings: DataFrame, block: int = CHUNK) -> DataFrame:
    """Samples without the excluded components; recordings that exclude nothing stay as they are."""
    rows = cleaning_matrix(state, excluded.filter(F.size("comps") > 0))
    bias = rows.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("out_idx", "b"))).getField("b").alias("bs"))
    per_key = matrix_per_key(rows, ["rec_id"]).join(bias.hint("merge"), "rec_id")
    chunks = attach(pack_blocks(samples, ["rec_id"], block), per_key, "rec_id", "left", bound=recordings, numbers=channel_count(recordings) ** 2, spread="block", heavy=HEAVY_CHUNKS)

    def run(row: dict) -> dict:
        x = matrix(row)
        if row["outs"] is not None and len(row["outs"]):
            x = x @ row["ws"].reshape(len(row["outs"]), -1).T + row["bs"]
        return {"rec_id": row["rec_id"], "t": row["ts"], "x": x}

    return map_chunks(chunks, run, "rec_id string, t bigint, x array<double>")
