"""Trained networks: depth curves by differential equations, operators, grids in time, diffusion and attention.

They are fitted on bounded tables; many fits (profiles, members of an ensemble) run side by side as groups in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.operators import autodiff as ad
from loamwork.operators.autodiff import Dense, Var
from loamwork.operators.neural import cosine_schedule, standardise

#: Nodes of a dense attention graph.
MAX_NODES = 2_000


def rk4_step(f: Callable, z: float, y, h: float):
    """One classical Runge-Kutta step of dy/dz = f(z, y); numbers, arrays and Vars alike."""
    a = f(z, y)
    b = f(z + h / 2, y + a * (h / 2))
    c = f(z + h / 2, y + b * (h / 2))
    return y + (a + b * 2.0 + c * 2.0 + f(z + h, y + c * h)) * (h / 6)


class DepthOde:
    """dy/dz as a small network of depth, value and covariates, integrated from the surface down by Runge-Kutta steps.

    Without covariates it is one profile with a start value; with them one network is shared by many profiles and the
    start value is a network of the covariates. Depths and values are scaled.
    """

    def __init__(self, z: np.ndarray, y: np.ndarray, y0: float | None = None, covariates: np.ndarray | None = None, hidden: tuple[int, ...] = (16, 16), steps: int = 4, epochs: int = 200, lr: float = 0.02, seed: int = 1):
        """z, y: depth and value of each observation; covariates: a row for each observation."""
        ok = np.isfinite(z) & np.isfinite(y) & (True if covariates is None else np.isfinite(covariates).all(axis=1))
        z, y = z[ok].astype(float), y[ok].astype(float)
        if len(z) < 2:
            raise ValueError("[DepthOde] two observations at least are needed")
        self.steps, self.depth = steps, max(float(z.max()), 1e-9)
        self.mean, self.sd = float(y.mean()), float(y.std(ddof=1)) or 1.0
        rng = np.random.default_rng(seed)
        self.c_mean = self.c_sd = None
        c = None
        if covariates is not None:
            c, self.c_mean, self.c_sd = standardise(covariates[ok])
        p = 0 if c is None else c.shape[1]
        self.rate = Dense(rng, [2 + p, *hidden, 1])
        self.start = Dense(rng, [p, 16, 1]) if p else Var([((y0 if y0 is not None else y[np.argmin(z)]) - self.mean) / self.sd])
        self.free = p > 0 or y0 is None
        params = [*self.rate.params(), *(self.start.params() if p else [self.start] if self.free else [])]
        target = (y - self.mean) / self.sd
        levels, at = np.unique(z, return_inverse=True)
        rows = np.arange(len(z))

        def loss() -> Var:
            path = self._path(levels, c, len(z) if p else 1)
            return ((path[at, rows if p else 0] - target) ** 2).mean()

        self.losses = ad.train(params, loss, epochs, lr)

    def _path(self, levels: np.ndarray, c: np.ndarray | None, n: int) -> Var:
        """Scaled values (depth x row) at sorted depths."""
        y = self.start(c) if c is not None else self.start.reshape(1, 1) * np.ones((n, 1))

        def f(z: float, y: Var) -> Var:
            return self.rate(ad.concat([Var(np.full((n, 1), z)), y, *([] if c is None else [Var(c)])], 1))

        out, at = [], 0.0
        for level in levels / self.depth:
            h = (level - at) / self.steps
            for k in range(self.steps):
                if h > 0:
                    y = rk4_step(f, at + k * h, y, h)
            at = level
            out.append(y.reshape(n))
        return ad.stack(out)

    def predict(self, depths: np.ndarray, covariates: np.ndarray | None = None) -> np.ndarray:
        """Values (row x depth); one row without covariates."""
        c = None if covariates is None else (covariates - self.c_mean) / self.c_sd
        order = np.argsort(depths, kind="stable")
        path = self._path(np.asarray(depths, float)[order], c, 1 if c is None else len(c)).value.T
        out = np.empty_like(path)
        out[:, order] = path * self.sd + self.mean
        return out

    def envelope(self, covariates: np.ndarray, depths=(0.0, 5.0, 15.0, 30.0, 60.0)) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest value of each row's curve, for a gate on candidates."""
        curves = self.predict(np.array(depths), covariates)
        return curves.min(axis=1), curves.max(axis=1)


def ode_params(fit: dict) -> dict:
    """Rate, decay, limit and surface value of a fitted decay with defaults for what is missing."""
    return {k: float(fit[k]) if fit.get(k) is not None and math.isfinite(fit[k]) else d for k, d in (("rate", 0.05), ("decay", 0.02), ("y_inf", 0.0), ("y0", 1.0))}


def ode_ensemble(df: DataFrame, key: str, depth: str, value: str, depths: list[float], members: int = 5, noise: bool = False, seed: int = 1, **fit) -> DataFrame:
    """key, depth, draw_id, value, error: curves of `members` networks per profile, differing in their start.

    A profile and member is a group in Spark. With noise each curve gets the residual deviation of its member. Profiles
    that can't be fitted have one row with the reason.
    """
    rows = df.select(key, depth, value).withColumn("member_", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        name, m = pdf[key].iloc[0], int(pdf.member_.iloc[0])
        z, y = pdf[depth].to_numpy(float), pdf[value].to_numpy(float)
        try:
            net = DepthOde(z, y, seed=seed + m, **fit)
        except ValueError as e:
            return pd.DataFrame({key: [name], "depth": [None], "draw_id": [m], "value": [None], "error": [str(e)]})
        curve = net.predict(np.array(depths))[0]
        if noise:
            curve = curve + np.random.default_rng(seed + m).normal(size=len(curve)) * np.nanstd(y - net.predict(z)[0])
        return pd.DataFrame({key: name, "depth": depths, "draw_id": m, "value": curve, "error": None})

    return rows.groupBy(key, "member_").applyInPandas(one, f"{key} {dict(df.dtypes)[key]}, depth double, draw_id int, value double, error string")


class CurveOperator:
    """Covariates to whole depth curves, every weight trained. kind 'fourier': blocks that mix the lowest Fourier modes
    along depth and the channels; kind 'branch': a network of the covariates times a network of depth."""

    def __init__(self, x: np.ndarray, curves: np.ndarray, depths: np.ndarray, kind: str = "fourier", width: int = 8, modes: int = 4, blocks: int = 2, epochs: int = 200, lr: float = 0.02, seed: int = 1):
        self.kind, self.blocks = kind, blocks
        z, self.mean, self.sd = standardise(x)
        target, self.y_mean, self.y_sd = standardise(curves)
        self.lo, self.span = float(np.min(depths)), max(1e-9, float(np.ptp(depths)))
        rng = np.random.default_rng(seed)
        p, self.width = x.shape[1], width
        self.depths = np.asarray(depths, float)
        if kind == "fourier":
            self.lift, self.out = Dense(rng, [p + 1, width]), Dense(rng, [width, 16, 1])
            k = min(modes, len(self.depths) // 2 + 1)
            n = len(self.depths)
            angle = 2 * math.pi * np.outer(np.arange(k), np.arange(n)) / n
            self.cos, self.sin = np.cos(angle), np.sin(angle)
            self.real, self.imag = ([Var(rng.normal(size=(k, width, width)) / width) for _ in range(blocks)] for _ in range(2))
            self.local = [ad.weights(rng, width, width) for _ in range(blocks)]
            params = [*self.lift.params(), *self.out.params(), *self.real, *self.imag, *self.local]
        else:
            self.branch, self.trunk, self.shift = Dense(rng, [p, 16, width]), Dense(rng, [1, 16, width]), Var(np.zeros(1))
            params = [*self.branch.params(), *self.trunk.params(), self.shift]
        self.losses = ad.train(params, lambda: ((self._forward(z, self.depths) - target) ** 2).mean(), epochs, lr)

    def _forward(self, z: np.ndarray, depths: np.ndarray) -> Var:
        d = (depths - self.lo) / self.span
        if self.kind != "fourier":
            return self.branch(Var(z)) @ self.trunk(Var(d[:, None])).transpose(1, 0) + self.shift
        n, m = len(z), len(d)
        grid = np.concatenate([np.repeat(z[:, None], m, axis=1), np.broadcast_to(d[None, :, None], (n, m, 1))], axis=2)
        h = self.lift(Var(grid.reshape(n * m, -1))).reshape(n, m, self.width)
        for b in range(self.blocks):
            re, im = ad.einsum("kd,ndw->nkw", Var(self.cos), h), ad.einsum("kd,ndw->nkw", Var(-self.sin), h)
            a, c = self.real[b], self.imag[b]
            to_re = ad.einsum("nkw,kwv->nkv", re, a) - ad.einsum("nkw,kwv->nkv", im, c)
            to_im = ad.einsum("nkw,kwv->nkv", re, c) + ad.einsum("nkw,kwv->nkv", im, a)
            back = ad.einsum("kd,nkw->ndw", Var(self.cos), to_re) - ad.einsum("kd,nkw->ndw", Var(self.sin), to_im)
            h = ad.tanh(back * (1.0 / m) + (h.reshape(n * m, self.width) @ self.local[b]).reshape(n, m, self.width))
        return self.out(h.reshape(n * m, self.width)).reshape(n, m)

    def predict(self, x: np.ndarray, depths: np.ndarray | None = None) -> np.ndarray:
        """Curves (row x depth), each depth scaled back by itself; other depths than those of the fit for 'branch' only,
        with scales interpolated between them."""
        depths = self.depths if depths is None else np.asarray(depths, float)
        if self.kind == "fourier" and not np.array_equal(depths, self.depths):
            raise ValueError("[CurveOperator] Fourier blocks know the depths of the fit only")
        mean, sd = (np.interp(depths, self.depths, v) for v in (self.y_mean, self.y_sd))
        return self._forward((x - self.mean) / self.sd, depths).value * sd + mean


class GridLstm:
    """Stacked convolutional long short-term memory over grids, with a 1 x 1 head, one value a cell and step.

    sequence: (steps, channels, height, width); target: (steps, height, width), or (height, width) of the last step.
    With physics > 0 the mean square of the stock's change less gains by the driver and losses in proportion is added.
    Dropout, if any, is on the hidden grids before the head.
    """

    def __init__(self, sequence: np.ndarray, target: np.ndarray, hidden: tuple[int, ...] = (4,), kernel: int = 3, epochs: int = 60, lr: float = 0.02, physics: float = 0.0, gain: float = 0.03, loss_rate: float = 0.015, driver: int = 1, dropout: float = 0.0, seed: int = 1):
        self.rng = np.random.default_rng(seed)
        self.hidden, self.dropout = hidden, dropout
        sizes = [sequence.shape[1], *hidden]
        self.gates = [ad.weights(self.rng, 4 * b, a + b, kernel, kernel) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.bias = [Var(np.r_[np.zeros(b), np.ones(b), np.zeros(2 * b)]) for b in hidden]
        self.head, self.shift = ad.weights(self.rng, 1, hidden[-1], 1, 1), Var(np.zeros(1))
        every = target.ndim == 3
        rain = sequence[:, min(driver, sequence.shape[1] - 1)]

        def loss() -> Var:
            got = self._run(sequence, drop=dropout > 0)
            total = ((got - target) ** 2).mean() if every else ((got[len(sequence) - 1] - target) ** 2).mean()
            if physics and len(sequence) > 1:
                off = got[1:] - got[:-1] - (gain * rain[:-1] - got[:-1] * (loss_rate * rain[:-1] / max(1e-9, abs(rain.mean()))))
                total = total + physics * (off**2).mean()
            return total

        self.losses = ad.train([*self.gates, *self.bias, self.head, self.shift], loss, epochs, lr)

    def cell(self, layer: int, x: Var, h: Var, c: Var) -> tuple[Var, Var]:
        """Hidden and cell grids after one step: input, forget and output gates and the candidate."""
        n = self.hidden[layer]
        g = ad.conv2d(ad.concat([x, h], 1), self.gates[layer], self.bias[layer])
        i, f, o, new = ad.sigmoid(g[:, :n]), ad.sigmoid(g[:, n : 2 * n]), ad.sigmoid(g[:, 2 * n : 3 * n]), ad.tanh(g[:, 3 * n :])
        c = f * c + i * new
        return o * ad.tanh(c), c

    def _run(self, sequence: np.ndarray, drop: bool = False) -> Var:
        _, _, height, width = sequence.shape
        state = [(Var(np.zeros((1, n, height, width))), Var(np.zeros((1, n, height, width)))) for n in self.hidden]
        out = []
        for grid in sequence:
            x = Var(grid[None])
            for layer in range(len(self.hidden)):
                state[layer] = self.cell(layer, x, *state[layer])
                x = state[layer][0]
            if drop:
                x = x * ((self.rng.random(x.shape) >= self.dropout) / (1 - self.dropout))
            out.append((ad.conv2d(x, self.head) + self.shift).reshape(height, width))
        return ad.stack(out)

    def predict(self, sequence: np.ndarray) -> np.ndarray:
        return self._run(sequence).value

    def rollout(self, past: np.ndarray, future: np.ndarray) -> np.ndarray:
        """The steps of `future` after those of `past`."""
        return self.predict(np.concatenate([past, future]))[len(past) :]

    def dropout_draws(self, sequence: np.ndarray, draws: int = 50, seed: int = 1) -> np.ndarray:
        """(draw, step, height, width) with dropout left on; without a rate there is nothing to draw, an error."""
        if not self.dropout:
            raise ValueError("[GridLstm] the network was fitted without dropout: its draws would be equal")
        self.rng = np.random.default_rng(seed)
        return np.stack([self._run(sequence, drop=True).value for _ in range(draws)])


def grid_ensemble(spark: SparkSession, sequence: np.ndarray, target: np.ndarray, future: np.ndarray, members: int = 10, seed: int = 101, **fit) -> DataFrame:
    """member, t, row, col, value: rollouts of networks that differ in their start, each fitted in a task of its own.
    The grids are a bounded cube that travels with the tasks; so do the classes, as executors lack this package."""
    sent = spark.sparkContext.broadcast((sequence, target, future))
    net = GridLstm

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        past, known, ahead = sent.value
        m = int(pdf["id"].iloc[0])
        grids = net(past, known, seed=seed + m, **fit).rollout(past, ahead)
        t, r, c = np.indices(grids.shape).reshape(3, -1)
        return pd.DataFrame({"member": m, "t": t, "row": r, "col": c, "value": grids.reshape(-1)})

    return spark.range(members).groupBy("id").applyInPandas(one, "member int, t int, row int, col int, value double")


def time_features(t: np.ndarray, dim: int = 8) -> np.ndarray:
    """Sines and cosines of a step's share, at doubling frequencies."""
    angle = np.asarray(t, float)[:, None] * math.pi * 2.0 ** np.arange(dim // 2)
    return np.concatenate([np.sin(angle), np.cos(angle)], axis=1)


class Denoiser:
    """Denoising diffusion of patches (n, height, width), optionally given conditions, every weight trained.

    kind 'dense': a network of the flattened patch; kind 'unet': convolutions at full and half size with a skip. A tenth
    of the conditions is blanked in training, so that samples can be drawn without any.
    """

    def __init__(self, patches: np.ndarray, conditions: np.ndarray | None = None, steps: int = 50, kind: str = "dense", hidden: int = 64, epochs: int = 150, lr: float = 0.005, batch: int = 64, seed: int = 1):
        self.rng, self.kind, self.shape = np.random.default_rng(seed), kind, patches.shape[1:]
        self.mean, self.sd = float(patches.mean()), float(patches.std()) or 1.0
        x = (patches - self.mean) / self.sd
        self.schedule, self.steps = cosine_schedule(steps), steps
        self.c = 0 if conditions is None else conditions.shape[1]
        c = np.zeros((len(x), 0)) if conditions is None else (conditions - conditions.mean(axis=0)) / np.maximum(conditions.std(axis=0), 1e-6)
        self.c_mean, self.c_sd = (None, None) if conditions is None else (conditions.mean(axis=0), np.maximum(conditions.std(axis=0), 1e-6))
        side = 8 + self.c
        if kind == "dense":
            size = int(np.prod(self.shape))
            self.net = Dense(self.rng, [size + side, hidden, hidden, size])
            params = self.net.params()
        else:
            n = max(4, hidden // 8)
            self.convs = [ad.weights(self.rng, *s) for s in ((n, 1, 3, 3), (2 * n, n, 3, 3), (2 * n, 2 * n, 3, 3), (n, 3 * n, 3, 3), (1, n, 3, 3))]
            self.into = Dense(self.rng, [side, 2 * n])
            params = [*self.convs, *self.into.params()]
        adam = ad.Adam(params, lr)
        self.losses = []
        for _ in range(epochs):
            at = self.rng.integers(0, len(x), min(batch, 4 * len(x)))
            t = self.rng.integers(0, steps, len(at))
            noise = self.rng.normal(size=(len(at), *self.shape))
            bar = self.schedule["alphabar"][t][:, None, None]
            seen = c[at] * (self.rng.random((len(at), 1)) >= 0.1)
            self.losses.append(adam.step(((self._noise(np.sqrt(bar) * x[at] + np.sqrt(1 - bar) * noise, t, seen) - noise) ** 2).mean()))

    def _noise(self, x: np.ndarray, t: np.ndarray, c: np.ndarray) -> Var:
        side = np.concatenate([time_features(t / self.steps), c], axis=1)
        if self.kind == "dense":
            return self.net(Var(np.concatenate([x.reshape(len(x), -1), side], axis=1))).reshape(len(x), *self.shape)
        a, b, mid, up, last = self.convs
        top = ad.tanh(ad.conv2d(Var(x[:, None]), a))
        low = ad.conv2d(ad.halve(top), b) + self.into(Var(side)).reshape(len(x), -1, 1, 1)
        low = ad.tanh(ad.conv2d(ad.tanh(low), mid))
        grown = ad.double(low)
        h, w = self.shape
        if grown.shape[2:] != (h, w):  # odd sizes: the edge is repeated
            grown = grown[:, :, np.minimum(np.arange(h), grown.shape[2] - 1)][:, :, :, np.minimum(np.arange(w), grown.shape[3] - 1)]
        return ad.conv2d(ad.tanh(ad.conv2d(ad.concat([grown, top], 1), up)), last).reshape(len(x), h, w)

    def sample(self, n: int, conditions: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
        """n patches from noise, step by step."""
        rng = np.random.default_rng(seed)
        c = np.zeros((n, self.c)) if conditions is None or not self.c else (np.broadcast_to(conditions, (n, self.c)) - self.c_mean) / self.c_sd
        x = rng.normal(size=(n, *self.shape))
        for t in range(self.steps - 1, -1, -1):
            a, bar, beta = (self.schedule[k][t] for k in ("alpha", "alphabar", "beta"))
            before = self.schedule["alphabar"][t - 1] if t else 1.0
            noise = self._noise(x, np.full(n, t), c).value
            clean = np.clip((x - math.sqrt(1 - bar) * noise) / math.sqrt(bar), -4, 4)
            x = (math.sqrt(before) * beta * clean + math.sqrt(a) * (1 - before) * x) / (1 - bar)
            if t:
                x = x + math.sqrt(beta) * rng.normal(size=x.shape)
        return x * self.sd + self.mean


class AttentionNet:
    """Attention layers of several heads over a neighbour graph, every weight trained on the labelled nodes.

    A score is the leaky sum of both ends' scores times the edge's weight; a node without neighbours keeps its own
    vector. The graph is dense, so its nodes are bounded. Labels of other nodes are never looked at.
    """

    def __init__(self, x: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, y: np.ndarray, labelled: np.ndarray, hidden: int = 16, heads: int = 2, layers: int = 2, epochs: int = 150, lr: float = 0.02, decay: float = 1e-4, seed: int = 1):
        if len(x) > MAX_NODES:
            raise ValueError(f"[AttentionNet] {len(x)} nodes; {MAX_NODES} at most, as the graph is dense")
        rng = np.random.default_rng(seed)
        self.z = standardise(np.nan_to_num(x))[0]
        self.edge = np.zeros((len(x), len(x)))
        self.edge[src, dst] = weight
        self.mean, self.sd = float(y[labelled].mean()), float(y[labelled].std(ddof=1)) or 1.0
        width, each = x.shape[1], max(1, hidden // heads)
        self.layers = []
        for _ in range(layers):
            self.layers.append([(ad.weights(rng, width, each), Var(rng.normal(size=(each, 1)) / each), Var(rng.normal(size=(each, 1)) / each)) for _ in range(heads)])
            width = each * heads
        self.head = Dense(rng, [width, 1])
        params = [p for layer in self.layers for head in layer for p in head] + self.head.params()
        target = (y[labelled] - self.mean) / self.sd
        self.losses = ad.train(params, lambda: ((self.head(self._embed()).reshape(len(x))[labelled] - target) ** 2).mean(), epochs, lr, decay)

    def _embed(self) -> Var:
        h, near = Var(self.z), self.edge > 0
        alone = ~near.any(axis=1)
        for layer in self.layers:
            out = []
            for w, left, right in layer:
                v = h @ w
                score = ad.relu(v @ left + (v @ right).transpose(1, 0), 0.2) * self.edge
                score = score + np.where(near, 0.0, -1e9)
                alpha = ad.exp(ad.log_softmax(score, 1)) * near
                out.append(alpha @ v + v * alone[:, None])
            h = ad.tanh(ad.concat(out, 1))
        return h

    def embed(self) -> np.ndarray:
        return self._embed().value

    def predict(self) -> np.ndarray:
        return self.head(self._embed()).value.reshape(-1) * self.sd + self.mean
