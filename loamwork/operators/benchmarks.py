"""Methods compared on one split: each gives draws (draw, row) for the test rows, from bounded tables."""

from __future__ import annotations

import numpy as np

from loamwork.operators.causal import Dag
from loamwork.operators.kernels import CircuitRidge
from loamwork.operators.networks import AttentionNet


def residual_sd(y: np.ndarray, fitted: np.ndarray) -> float:
    """Deviation of the finite residuals; 0 with fewer than two."""
    e = (y - fitted)[np.isfinite(y - fitted)]
    return float(e.std(ddof=1)) if len(e) > 1 else 0.0


def with_noise(draws: np.ndarray, sd: float, seed: int = 1) -> np.ndarray:
    return draws + sd * np.random.default_rng(seed).normal(size=draws.shape)


def _design(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


def regression_draws(train: np.ndarray, y: np.ndarray, test: np.ndarray, names: list[str], outcome: str = "y", dag: Dag | None = None, draws: int = 300, calibrate: bool = True, seed: int = 1) -> np.ndarray:
    """Least squares on the outcome's parents in the graph (all columns without one), over bootstrap samples of rows."""
    use = [i for i, n in enumerate(names) if dag is None or n in dag.parents(outcome)] or list(range(len(names)))
    a, b = _design(train[:, use]), _design(test[:, use])
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(draws):
        rows = rng.integers(0, len(y), len(y))
        out.append(b @ np.linalg.lstsq(a[rows], y[rows], rcond=None)[0])
    sd = residual_sd(y, a @ np.linalg.lstsq(a, y, rcond=None)[0])
    return with_noise(np.array(out), sd, seed) if calibrate else np.array(out)


def circuit_draws(train: np.ndarray, y: np.ndarray, test: np.ndarray, components: int = 6, reps: int = 2, lam: float = 0.5, draws: int = 20, calibrate: bool = True, seed: int = 1) -> np.ndarray:
    """Kernel ridges on a circuit's kernel over principal components, over bootstrap samples of rows."""
    rng, mean = np.random.default_rng(seed), y.mean()
    fit = lambda rows: CircuitRidge(train[rows], y[rows] - mean, reps, lam, min(components, train.shape[1]))
    out = np.array([fit(np.sort(rng.integers(0, len(y), len(y)))).predict(test) + mean for _ in range(draws)])
    return with_noise(out, residual_sd(y, fit(np.arange(len(y))).predict(train) + mean), seed) if calibrate else out


def attention_draws(train: np.ndarray, y: np.ndarray, test: np.ndarray, place: np.ndarray, k: int = 8, members: int = 5, calibrate: bool = True, seed: int = 1, **fit) -> np.ndarray:
    """Attention nets over the neighbour graph of train and test sites together (place in that order), differing in
    their start. The test sites' labels are never looked at."""
    x, n = np.vstack([train, test]), len(train)
    d = np.sqrt(((place[:, None] - place[None]) ** 2).sum(axis=-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    src, dst = np.repeat(np.arange(len(x)), near.shape[1]), near.reshape(-1)
    w = 1 / (d[src, dst] + 1e-9)
    w = w / np.bincount(src, w)[src]
    labels = np.concatenate([y, np.zeros(len(test))])
    nets = [AttentionNet(x, src, dst, w, labels, np.arange(n), seed=seed + m, **fit).predict() for m in range(members)]
    out = np.array([p[n:] for p in nets])
    return with_noise(out, residual_sd(y, np.mean(nets, axis=0)[:n]), seed) if calibrate else out
