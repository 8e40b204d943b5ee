"""Spherical spline weights (Perrin et al. 1989) for estimating electrodes from other electrodes."""

from __future__ import annotations

import numpy as np

# Fixed values of the spline: order, number of Legendre terms, ridge on the diagonal.
ORDER = 4
TERMS = 50
RIDGE = 1e-5


def _kernel(cosines: np.ndarray) -> np.ndarray:
    n = np.arange(1, TERMS + 1, dtype=float)
    factors = np.concatenate([[0.0], (2 * n + 1) / ((n * (n + 1)) ** ORDER * 4 * np.pi)])
    return np.polynomial.legendre.legval(cosines, factors)


def _on_sphere(pos: np.ndarray) -> np.ndarray:
    return pos / np.linalg.norm(pos, axis=1, keepdims=True)


def spline_weights(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Matrix (targets, sources): values at ``target`` positions as sums over values at ``source`` positions."""
    source, target = _on_sphere(source), _on_sphere(target)
    n = len(source)
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = _kernel(np.clip(source @ source.T, -1, 1)) + RIDGE * np.eye(n)
    system[n, n] = 0.0
    reach = np.hstack([_kernel(np.clip(target @ source.T, -1, 1)), np.ones((len(target), 1))])
    return (reach @ np.linalg.pinv(system))[:, :n]
