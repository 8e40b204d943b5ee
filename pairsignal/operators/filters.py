"""Zero-phase FIR filters over long recordings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsignal.functions.chunks import CHUNK, map_chunks, matrix, pack
from pairsignal.operators.blocks import attach, with_halo

# Length factor of the Hamming window design, and the high-pass edge of the cleaning step.
LENGTH_FACTOR = 3.3
HIGHPASS_HZ = 1.0
DIRECT_TAPS = 64  # shorter filters are summed tap by tap, longer ones go through the FFT


def tap_count(sfreq: float, transition: float) -> int:
    n = int(np.ceil(LENGTH_FACTOR / transition * sfreq))
    return n + 1 - n % 2


def lowpass_taps(sfreq: float, cutoff: float, n: int) -> np.ndarray:
    """Windowed-sinc low-pass with unit gain at 0 Hz; ``cutoff`` is the half-amplitude frequency."""
    k = np.arange(n) - n // 2
    taps = np.sinc(2 * cutoff / sfreq * k) * np.hamming(n)
    return taps / taps.sum()


def highpass_taps(sfreq: float, cutoff: float, n: int) -> np.ndarray:
    taps = -lowpass_taps(sfreq, cutoff, n)
    taps[n // 2] += 1.0
    return taps


def design(sfreq: float, l_freq: float | None, h_freq: float | None) -> np.ndarray:
    """Taps of a high-, low- or band-pass with automatic transition widths."""
    widths = []
    if l_freq is not None:
        widths.append(min(max(0.25 * l_freq, 2.0), l_freq))
    if h_freq is not None:
        widths.append(min(max(0.25 * h_freq, 2.0), sfreq / 2 - h_freq))
    n = tap_count(sfreq, min(widths))
    taps = np.zeros(n)
    taps[n // 2] = 1.0
    if h_freq is not None:
        taps = lowpass_taps(sfreq, h_freq + widths[-1] / 2, n)
    if l_freq is not None:
        taps = taps - lowpass_taps(sfreq, l_freq - widths[0] / 2, n)
    return taps


def _extended(x: np.ndarray, t: np.ndarray, start: int, stop: int, total: int) -> np.ndarray:
    """Samples at ``start..stop-1``; outside the recording the signal continues point-mirrored, then as zeros."""
    grid = np.arange(start, stop)
    out = np.zeros((len(grid), x.shape[1]))
    inside = (grid >= 0) & (grid < total)
    out[inside] = x[grid[inside] - t[0]]
    left = (grid < 0) & (-grid < total)
    out[left] = 2 * x[0 - t[0]] - x[-grid[left] - t[0]] if left.any() else 0.0
    mirrored = 2 * (total - 1) - grid
    right = (grid >= total) & (mirrored >= 0)
    out[right] = 2 * x[total - 1 - t[0]] - x[mirrored[right] - t[0]] if right.any() else 0.0
    return out


def _convolve(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Valid part of the convolution along axis 0."""
    n = len(x) - len(taps) + 1
    if len(taps) <= DIRECT_TAPS:
        out = np.zeros((n, x.shape[1]))
        for k, h in enumerate(taps[::-1]):
            out += h * x[k : k + n]
        return out
    size = 1 << (len(x) - 1).bit_length()
    spectrum = np.fft.rfft(x, size, axis=0) * np.fft.rfft(taps, size)[:, None]
    return np.fft.irfft(spectrum, size, axis=0)[len(taps) - 1 : len(x)]


def filter_blocks(samples: DataFrame, recordings: DataFrame, taps_of: Callable[[float], np.ndarray], half_width,
                  block: int = CHUNK, residual: bool = False) -> DataFrame:
    """Filter every recording with ``taps_of(sfreq)``; ``half_width`` (number or Column) bounds the taps' reach.

    With ``residual`` the channels are followed by what the filter took away from each.
    """
    meta = recordings.select("rec_id", F.col("sfreq").alias("_f"), F.col("n_samples").alias("_n"))
    rows = attach(samples, meta, "rec_id", bound=recordings)
    spread = with_halo(rows, block, half_width, half_width).filter(F.col("block") * block < F.col("_n"))
    chunks = attach(
        pack(spread.select("rec_id", "block", "t", "x"), ["rec_id"]), meta, "rec_id", bound=recordings, spread="block"
    )

    known: dict[float, np.ndarray] = {}

    def run(row: dict) -> dict | None:
        t, x = row["ts"], matrix(row)
        if row["_f"] not in known:
            known[row["_f"]] = taps_of(row["_f"])
        taps = known[row["_f"]]
        h = len(taps) // 2
        start, stop = row["block"] * block, min((row["block"] + 1) * block, row["_n"])
        whole = _extended(x, t, start - h, stop + h, row["_n"])
        out = _convolve(whole, taps)
        if residual:
            out = np.hstack([out, whole[h : len(whole) - h] - out])
        return {"rec_id": row["rec_id"], "t": np.arange(start, stop), "x": out}

    return map_chunks(chunks, run, "rec_id string, t bigint, x array<double>")


def fir(samples: DataFrame, recordings: DataFrame, taps: list[float], block: int = CHUNK, residual: bool = False) -> DataFrame:
    """One set of odd-length taps for all recordings."""
    fixed = np.asarray(taps, dtype=float)
    return filter_blocks(samples, recordings, lambda sfreq: fixed, len(fixed) // 2, block, residual)


def band(samples: DataFrame, recordings: DataFrame, l_freq: float | None = HIGHPASS_HZ, h_freq: float | None = None,
         block: int = CHUNK, residual: bool = False) -> DataFrame:
    """High-, low- or band-pass designed for each recording's own rate."""
    width = F.lit(float("inf"))
    if l_freq is not None:
        width = F.least(width, F.lit(min(max(0.25 * l_freq, 2.0), l_freq)))
    if h_freq is not None:
        width = F.least(width, F.lit(max(0.25 * h_freq, 2.0)), F.col("_f") / 2 - h_freq)
    reach = (F.ceil(LENGTH_FACTOR / width * F.col("_f")) / 2).cast("bigint") + 1
    return filter_blocks(samples, recordings, lambda sfreq: design(sfreq, l_freq, h_freq), reach, block, residual)
