"""Networks as fixed random features with a trained linear head, in numpy on bounded tables."""

from __future__ import annotations

import math

import numpy as np


def head(features: np.ndarray, y: np.ndarray, lam: float = 0.1) -> np.ndarray:
    f = np.column_stack([np.ones(len(features)), features])
    return np.linalg.solve(f.T @ f + lam * np.eye(f.shape[1]), f.T @ y)


def apply_head(features: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(features)), features]) @ w


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column z-scores; a deviation under 1e-6 counts as 1."""
    mean, sd = x.mean(axis=0), x.std(axis=0, ddof=1)
    sd = np.where(sd < 1e-6, 1.0, sd)
    return (x - mean) / sd, mean, sd


class OperatorNet:
    """Covariates to whole depth curves: random branch features times Fourier ('fourier') or random ('branch') trunk
    features of depth, and a ridge head. Each depth is scaled and scaled back by itself."""

    def __init__(self, p: np.ndarray, curves: np.ndarray, depths: np.ndarray, kind: str = "fourier", width: int = 24, modes: int = 4, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.kind, self.modes, self.depths = kind, modes, depths
        _, self.mean, self.sd = standardise(p)
        target, self.y_mean, self.y_sd = standardise(curves)
        self.branch = rng.normal(size=(p.shape[1] + 1, width)) / math.sqrt(p.shape[1] + 1)
        self.trunk = rng.normal(size=(2, 2 * modes))
        f = self.features(p)
        self.w = head(f.reshape(-1, f.shape[-1]), target.reshape(-1))

    def features(self, p: np.ndarray) -> np.ndarray:
        x = (p - self.mean) / self.sd
        b = np.tanh(np.column_stack([x, np.ones(len(x))]) @ self.branch)
        z = (self.depths - self.depths.min()) / max(1e-9, np.ptp(self.depths))
        k = np.arange(1, self.modes + 1)
        t = np.concatenate([np.sin(math.pi * np.outer(z, k)), np.cos(math.pi * np.outer(z, k))], axis=1) if self.kind == "fourier" else np.tanh(np.column_stack([z, np.ones(len(z))]) @ self.trunk)
        t = np.column_stack([np.ones(len(z)), t])
        return (b[:, None, :, None] * t[None, :, None, :]).reshape(len(x), len(z), -1)

    def predict(self, p: np.ndarray) -> np.ndarray:
        f = self.features(p)
        return apply_head(f.reshape(-1, f.shape[-1]), self.w).reshape(len(p), -1) * self.y_sd + self.y_mean


def cosine_schedule(steps: int, s: float = 0.008) -> dict[str, np.ndarray]:
    t = np.arange(steps + 1)
    f = np.cos((t / steps + s) / (1 + s) * math.pi / 2) ** 2
    bar = np.clip(f / f[0], 1e-8, 0.9999)
    alpha = bar[1:] / bar[:-1]
    return {"alphabar": bar[1:], "alpha": alpha, "beta": 1 - alpha}


class Diffusion:
    """Denoising of flattened patches: noise is predicted from random features of the noisy patch and the step."""

    def __init__(self, patches: np.ndarray, steps: int = 50, width: int = 128, copies: int = 20, seed: int = 1):
        self.rng = np.random.default_rng(seed)
        self.x, self.mean, self.sd = standardise(patches.reshape(len(patches), -1))
        self.schedule, self.shape = cosine_schedule(steps), patches.shape[1:]
        d = self.x.shape[1]
        self.v = self.rng.normal(size=(d + 5, width)) / math.sqrt(d + 5)
        x = np.repeat(self.x, copies, axis=0)
        t = self.rng.integers(0, steps, len(x))
        noise = self.rng.normal(size=x.shape)
        bar = self.schedule["alphabar"][t][:, None]
        self.w = head(self.features(np.sqrt(bar) * x + np.sqrt(1 - bar) * noise, t), noise)

    def features(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        u = t / len(self.schedule["alphabar"])
        step = np.column_stack([u, np.sin(math.pi * u), np.cos(math.pi * u), np.sin(2 * math.pi * u), np.ones(len(u))])
        return np.column_stack([x, np.tanh(np.column_stack([x, step]) @ self.v)])

    def sample(self, n: int) -> np.ndarray:
        x = self.rng.normal(size=(n, self.x.shape[1]))
        for t in range(len(self.schedule["alphabar"]) - 1, -1, -1):
            a, bar, beta = (self.schedule[k][t] for k in ("alpha", "alphabar", "beta"))
            before = self.schedule["alphabar"][t - 1] if t else 1.0
            noise = apply_head(self.features(x, np.full(n, t)), self.w)
            # the clean patch that this noise implies, held to the range of z-scores, keeps early steps from running off
            clean = np.clip((x - math.sqrt(1 - bar) * noise) / math.sqrt(bar), -3, 3)
            x = (math.sqrt(before) * beta * clean + math.sqrt(a) * (1 - before) * x) / (1 - bar)
            if t:
                x = x + math.sqrt(beta) * self.rng.normal(size=x.shape)
        return (x * self.sd + self.mean).reshape(n, *self.shape)


class GraphNet:
    """Attention layers with random weights over a neighbour graph and a ridge head on the labelled nodes only."""

    def __init__(self, x: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, layers: int = 2, width: int = 16, seed: int = 1):
        rng = np.random.default_rng(seed)
        z = standardise(np.nan_to_num(x))[0]
        for _ in range(layers):
            w = rng.normal(size=(z.shape[1], width)) / math.sqrt(z.shape[1])
            h = z @ w
            score = h @ rng.normal(size=width) / math.sqrt(width), h @ rng.normal(size=width) / math.sqrt(width)
            e = score[0][src] + score[1][dst]
            e = np.where(e > 0, e, 0.2 * e) * weight
            top = np.full(len(z), -np.inf)
            np.maximum.at(top, src, e)
            a = np.exp(e - top[src])
            total = np.zeros(len(z))
            np.add.at(total, src, a)
            out = np.zeros_like(h)
            np.add.at(out, src, (a / total[src])[:, None] * h[dst])
            z = np.tanh(np.where((total > 0)[:, None], out, h))
        self.embedding = z

    def predict(self, y: np.ndarray, labelled: np.ndarray) -> np.ndarray:
        return apply_head(self.embedding, head(self.embedding[labelled], y[labelled]))
