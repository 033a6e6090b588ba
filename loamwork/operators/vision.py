"""Patch encoders: contrastive pretraining, embeddings of rasters and sites, heads fitted on top of them.

Patches are arrays (n, channels, height, width) of a bounded sample; a raster of any size is embedded in Spark, patch by
patch, with the encoder broadcast.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.operators import autodiff as ad
from loamwork.operators.autodiff import Dense, Var


class Encoder:
    """Convolutions to a feature vector, and a projection of unit length for the contrast. kind 'plain': two layers; kind
    'residual': five, two of them around a shortcut."""

    def __init__(self, channels: int, features: int = 32, projection: int = 16, kind: str = "plain", seed: int = 1):
        rng = np.random.default_rng(seed)
        self.kind, self.channels, self.features = kind, channels, features
        sizes = [(8, channels), (16, 8)] if kind == "plain" else [(8, channels), (16, 8), (16, 16), (16, 16), (16, 16)]
        self.convs = [ad.weights(rng, o, i, 3, 3) for o, i in sizes]
        self.bias = [Var(np.zeros(o)) for o, _ in sizes]
        self.out, self.project = Dense(rng, [16, features]), Dense(rng, [features, features, projection], ad.relu)

    def params(self) -> list[Var]:
        return [*self.convs, *self.bias, *self.out.params(), *self.project.params()]

    def forward(self, x: np.ndarray) -> Var:
        conv = lambda h, i: ad.relu(ad.conv2d(h, self.convs[i], self.bias[i]), 0.1)
        h = conv(Var(x), 0)
        h = conv(ad.halve(h) if min(h.shape[2:]) > 1 else h, 1)
        if self.kind == "residual":
            h = h + conv(conv(h, 2), 3)
            h = conv(ad.halve(h) if min(h.shape[2:]) > 1 else h, 4)
        return self.out(h.mean((2, 3)))

    def projected(self, x: np.ndarray) -> Var:
        z = self.project(self.forward(x))
        return z / ((z**2).sum(1, keepdims=True) + 1e-12) ** 0.5

    def embed(self, x: np.ndarray, projection: bool = False, batch: int = 256) -> np.ndarray:
        one = self.projected if projection else self.forward
        return np.concatenate([one(x[i : i + batch]).value for i in range(0, len(x), batch)]) if len(x) else np.zeros((0, self.features))

    def state(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *[p.value for p in self.params()])
        return out.getvalue()

    def load(self, state: bytes) -> Encoder:
        with np.load(io.BytesIO(state)) as held:
            values = [held[f"arr_{i}"] for i in range(len(held.files))]
        if [v.shape for v in values] != [p.shape for p in self.params()]:
            raise ValueError("[Encoder] the weights are of another network")
        for p, v in zip(self.params(), values, strict=True):
            p.value = v
        return self


# augmentations: (patches, generator) -> patches


def flipped(x: np.ndarray, rng: np.random.Generator, share: float = 0.5) -> np.ndarray:
    out = x.copy()
    for axis in (2, 3):
        at = rng.random(len(x)) < share
        out[at] = np.flip(out[at], axis=axis)
    return out


def turned(x: np.ndarray, rng: np.random.Generator, share: float = 0.75) -> np.ndarray:
    if x.shape[2] != x.shape[3]:
        return x
    return np.stack([np.rot90(p, rng.integers(1, 4), axes=(1, 2)) if rng.random() < share else p for p in x])


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resampling of the last two axes, corners on corners."""
    h, w = x.shape[-2:]
    r, c = np.linspace(0, h - 1, height), np.linspace(0, w - 1, width)
    r0, c0 = np.minimum(r.astype(int), max(0, h - 2)), np.minimum(c.astype(int), max(0, w - 2))
    r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
    fr, fc = (r - r0)[:, None], (c - c0)[None, :]
    at = lambda i, j: x[..., i[:, None], j[None, :]]
    return (at(r0, c0) * (1 - fc) + at(r0, c1) * fc) * (1 - fr) + (at(r1, c0) * (1 - fc) + at(r1, c1) * fc) * fr


def cropped(x: np.ndarray, rng: np.random.Generator, low: float = 0.6, high: float = 1.0) -> np.ndarray:
    out = []
    _, _, h, w = x.shape
    for p in x:
        share = rng.uniform(low, high)
        a, b = max(1, round(share * h)), max(1, round(share * w))
        i, j = rng.integers(0, h - a + 1), rng.integers(0, w - b + 1)
        out.append(resized(p[:, i : i + a, j : j + b], h, w))
    return np.stack(out)


def without_channels(x: np.ndarray, rng: np.random.Generator, share: float = 0.2) -> np.ndarray:
    keep = rng.random(x.shape[:2]) >= share
    keep[~keep.any(axis=1)] = True  # never all
    return x * keep[:, :, None, None]


def cut_out(x: np.ndarray, rng: np.random.Generator, share: float = 0.3, size: float = 0.2) -> np.ndarray:
    out = x.copy()
    a, b = max(1, round(size * x.shape[2])), max(1, round(size * x.shape[3]))
    for p in out:
        if rng.random() < share:
            i, j = rng.integers(0, x.shape[2] - a + 1), rng.integers(0, x.shape[3] - b + 1)
            p[:, i : i + a, j : j + b] = 0
    return out


def noisy(x: np.ndarray, rng: np.random.Generator, sd: float = 0.1) -> np.ndarray:
    return x + sd * rng.normal(size=x.shape)


def brightened(x: np.ndarray, rng: np.random.Generator, jitter: float = 0.2) -> np.ndarray:
    return x * (1 + rng.uniform(-jitter, jitter, (len(x), 1, 1, 1)))


def augment(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    for change in (cropped, flipped, turned, without_channels, cut_out, brightened, noisy):
        x = change(x, rng)
    return x


# contrast


def nt_xent(a: Var, b: Var, temperature: float = 0.2) -> Var:
    """Two views of each patch must find one another among all others."""
    n = a.shape[0]
    z = ad.concat([a, b], 0)
    scores = (z @ z.transpose(1, 0)) * (1 / temperature) + np.diag(np.full(2 * n, -1e9))
    pairs = (np.arange(2 * n), np.r_[np.arange(n, 2 * n), np.arange(n)])
    return -ad.log_softmax(scores, 1)[pairs].mean()


def info_nce(query: Var, key: np.ndarray, queue: np.ndarray, temperature: float = 0.07) -> Var:
    """A patch's query must find its key among earlier keys."""
    good = (query * key).sum(1, keepdims=True)
    scores = ad.concat([good, query @ queue.T], 1) * (1 / temperature)
    return -ad.log_softmax(scores, 1)[:, 0].mean()


def pretrain_pairs(patches: np.ndarray, features: int = 32, projection: int = 16, batch: int = 8, epochs: int = 10, lr: float = 0.005, temperature: float = 0.2, seed: int = 1) -> tuple[Encoder, list[float]]:
    """An encoder trained on two views of each patch of a batch."""
    rng = np.random.default_rng(seed)
    net = Encoder(patches.shape[1], features, projection, "plain", seed)
    adam, losses = ad.Adam(net.params(), lr), []
    view = lambda x: noisy(brightened(flipped(x, rng), rng), rng)
    for _ in range(epochs):
        order, total = rng.permutation(len(patches)), []
        for i in range(0, len(order) - 1, batch):
            x = patches[order[i : i + batch]]
            if len(x) > 1:
                total.append(adam.step(nt_xent(net.projected(view(x)), net.projected(view(x)), temperature)))
        losses.append(float(np.mean(total)))
    return net, losses


def pretrain_queue(batches: Callable[[int], Iterator[np.ndarray]], channels: int, features: int = 32, projection: int = 16, queue_size: int = 256, momentum: float = 0.99, temperature: float = 0.07, epochs: int = 5, lr: float = 0.005, seed: int = 1, checkpoint: Callable[[int, bytes, bytes], None] | None = None, resume: tuple[int, bytes, bytes] | None = None) -> tuple[Encoder, list[float]]:
    """An encoder trained against a queue of keys that a slowly following copy of it makes.

    batches(epoch) gives the patches of an epoch a batch at a time, so they may be streamed from tiles. checkpoint gets
    the epoch and both networks' weights; resume goes on from there.
    """
    rng = np.random.default_rng(seed)
    net, slow = (Encoder(channels, features, projection, "residual", seed) for _ in range(2))
    first = 0
    if resume is not None:
        first = resume[0] + 1
        net.load(resume[1])
        slow.load(resume[2])
    queue = rng.normal(size=(queue_size, projection))
    queue /= np.linalg.norm(queue, axis=1, keepdims=True)
    adam, losses, at = ad.Adam(net.params(), lr), [], 0
    for epoch in range(first, epochs):
        total = []
        for x in batches(epoch):
            key = slow.projected(augment(x, rng)).value
            total.append(adam.step(info_nce(net.projected(augment(x, rng)), key, queue, temperature)))
            for p, q in zip(slow.params(), net.params(), strict=True):
                p.value = momentum * p.value + (1 - momentum) * q.value
            place = (at + np.arange(len(key))) % queue_size
            queue[place], at = key, (at + len(key)) % queue_size
        losses.append(float(np.mean(total)))
        if checkpoint is not None:
            checkpoint(epoch, net.state(), slow.state())
    return net, losses


def array_batches(patches: np.ndarray, batch: int = 16, seed: int = 1) -> Callable[[int], Iterator[np.ndarray]]:
    def one(epoch: int) -> Iterator[np.ndarray]:
        order = np.random.default_rng([seed, epoch]).permutation(len(patches))
        yield from (patches[order[i : i + batch]] for i in range(0, len(order), batch))

    return one


# heads


def validation_rows(n: int, share: float, seed: int = 1) -> np.ndarray:
    """Which rows are held out: at least one."""
    out = np.zeros(n, bool)
    out[np.random.default_rng(seed).permutation(n)[: max(1, int(share * n))]] = True
    return out


class Head:
    """A classifier or regressor on an encoder, the encoder frozen or trained along at a smaller rate.

    The weights of the best epoch on the held-out rows stay. dropout is on the features before the last layer.
    """

    def __init__(self, encoder: Encoder, x: np.ndarray, y: np.ndarray, task: str = "class", hidden: tuple[int, ...] = (), dropout: float = 0.0, freeze: bool = True, loss: str = "mse", epochs: int = 60, lr: float = 0.02, decay: float = 0.0, backbone_rate: float = 0.1, held_out: float = 0.2, seed: int = 1):
        self.task, self.dropout, self.rng = task, dropout, np.random.default_rng(seed)
        self.encoder = Encoder(encoder.channels, encoder.features, encoder.project.w[-1].shape[1], encoder.kind).load(encoder.state())
        if task == "class":
            self.levels = sorted(set(y.tolist()))
            target, out = np.array([self.levels.index(v) for v in y.tolist()]), len(self.levels)
        else:
            self.mean, self.sd = float(np.mean(y)), float(np.std(y, ddof=1)) or 1.0
            target, out = (y - self.mean) / self.sd, 1
        fixed = self.encoder.embed(x)
        self.f_mean, self.f_sd = fixed.mean(axis=0), np.maximum(fixed.std(axis=0), 1e-6)
        self.net = Dense(self.rng, [encoder.features, *hidden, out], ad.relu)
        held = validation_rows(len(x), held_out, seed)

        def cost(rows: np.ndarray, drop: bool) -> Var:
            f = Var(fixed[rows]) if freeze else self.encoder.forward(x[rows])
            got = self._scores(f, drop)
            if task == "class":
                return -ad.log_softmax(got, 1)[np.arange(len(rows)), target[rows]].mean()
            off = got.reshape(len(rows)) - target[rows]
            return ad.huber(off).mean() if loss == "huber" else (off**2).mean()

        back = [] if freeze else self.encoder.params()
        params = [*self.net.params(), *back]
        adam = ad.Adam(params, lr, decay, [1.0] * len(self.net.params()) + [backbone_rate] * len(back))
        rows, tests = np.flatnonzero(~held), np.flatnonzero(held)
        best, kept = np.inf, [p.value for p in params]
        self.losses = []
        for _ in range(epochs):
            self.losses.append(adam.step(cost(rows, dropout > 0)))
            now = float(cost(tests, False).value)
            if now < best:
                best, kept = now, [p.value for p in params]
        for p, v in zip(params, kept, strict=True):
            p.value = v
        self.held_out_loss = best

    def _scores(self, f: Var, drop: bool) -> Var:
        f = (f - self.f_mean) / self.f_sd
        if drop:
            f = f * ((self.rng.random(f.shape) >= self.dropout) / (1 - self.dropout))
        return self.net(f)

    def _answer(self, scores: Var) -> np.ndarray:
        return np.exp(ad.log_softmax(scores, 1).value) if self.task == "class" else scores.value[:, 0] * self.sd + self.mean

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Shares of the classes (row x level), or values."""
        return self._answer(self._scores(Var(self.encoder.embed(x)), False))

    def classes(self, x: np.ndarray) -> list:
        return [self.levels[i] for i in self.predict(x).argmax(axis=1)]

    def dropout_draws(self, x: np.ndarray, draws: int = 50, seed: int = 1) -> np.ndarray:
        if not self.dropout:
            raise ValueError("[Head] the head was fitted without dropout: its draws would be equal")
        self.rng = np.random.default_rng(seed)
        f = self.encoder.embed(x)
        return np.stack([self._answer(self._scores(Var(f), True)) for _ in range(draws)])


def head_ensemble(encoder: Encoder, x: np.ndarray, y: np.ndarray, new: np.ndarray, members: int = 5, seed: int = 301, **fit) -> np.ndarray:
    """Answers of heads that differ in their start: (member, row) or (member, row, class)."""
    return np.stack([Head(encoder, x, y, seed=seed + m, **fit).predict(new) for m in range(members)])


# rasters and tiles


def extent(aoi) -> tuple[float, float, float, float]:
    """(xmin, xmax, ymin, ymax) of a mapping or of four numbers in that order."""
    out = tuple(float(aoi[k]) for k in ("xmin", "xmax", "ymin", "ymax")) if isinstance(aoi, dict) else tuple(map(float, aoi))
    if len(out) != 4 or out[0] >= out[1] or out[2] >= out[3]:
        raise ValueError("[extent] four numbers: xmin < xmax, ymin < ymax")
    return out


def aligned(layers: list[tuple[np.ndarray, tuple]], resolution: float) -> tuple[np.ndarray, tuple]:
    """Layers (grid, extent), row 0 in the north, resampled bilinearly to cells over the union of their extents; cells
    outside of a layer are NaN."""
    boxes = [extent(e) for _, e in layers]
    box = min(b[0] for b in boxes), max(b[1] for b in boxes), min(b[2] for b in boxes), max(b[3] for b in boxes)
    nx, ny = max(1, round((box[1] - box[0]) / resolution)), max(1, round((box[3] - box[2]) / resolution))
    xs, ys = box[0] + (np.arange(nx) + 0.5) * resolution, box[3] - (np.arange(ny) + 0.5) * resolution
    out = []
    for (grid, _), (x0, x1, y0, y1) in zip(layers, boxes, strict=True):
        h, w = grid.shape
        c, r = (xs - x0) / (x1 - x0) * w - 0.5, (y1 - ys) / (y1 - y0) * h - 0.5
        inside = ((r >= -0.5) & (r <= h - 0.5))[:, None] & ((c >= -0.5) & (c <= w - 0.5))[None, :]
        r, c = np.clip(r, 0, h - 1), np.clip(c, 0, w - 1)
        r0, c0 = np.minimum(r.astype(int), max(0, h - 2)), np.minimum(c.astype(int), max(0, w - 2))
        r1, c1, fr, fc = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1), (r - r0)[:, None], (c - c0)[None, :]
        v = (grid[r0][:, c0] * (1 - fc) + grid[r0][:, c1] * fc) * (1 - fr) + (grid[r1][:, c0] * (1 - fc) + grid[r1][:, c1] * fc) * fr
        out.append(np.where(inside, v, np.nan))
    return np.stack(out), box


class TileSet:
    """Patches of a stack (bands, height, width): z-scores per band with gaps as 0, centres away from the margin and, if
    there is a mask, on it."""

    def __init__(self, stack: np.ndarray, size: int = 16, valid: np.ndarray | None = None):
        self.mean = np.nanmean(stack, axis=(1, 2))
        sd = np.nanstd(stack, axis=(1, 2), ddof=1)
        self.sd = np.where(np.isfinite(sd) & (sd > 1e-6), sd, 1.0)
        self.size, self.stack = size, np.nan_to_num((stack - self.mean[:, None, None]) / self.sd[:, None, None])
        _, h, w = stack.shape
        ok = np.zeros((h, w), bool)
        half = size // 2
        ok[half : h - (size - half) + 1, half : w - (size - half) + 1] = True
        self.centres = np.argwhere(ok if valid is None else ok & valid)

    def patch(self, row: int, col: int) -> np.ndarray:
        half = self.size // 2
        return self.stack[:, row - half : row - half + self.size, col - half : col - half + self.size]

    def sample(self, n: int, seed: int = 1) -> np.ndarray:
        if not len(self.centres):
            raise ValueError("[TileSet] no centre is valid")
        rng = np.random.default_rng(seed)
        return np.stack([self.patch(*self.centres[i]) for i in rng.integers(0, len(self.centres), n)])

    def batches(self, n: int, batch: int = 16, seed: int = 1) -> Callable[[int], Iterator[np.ndarray]]:
        """Patches of an epoch, read window by window."""
        return lambda epoch: (self.sample(min(batch, n - i), seed * 100_003 + epoch * 1_009 + i) for i in range(0, n, batch))

    def embed_sites(self, encoder: Encoder, xy: np.ndarray, box: tuple) -> np.ndarray:
        """Embeddings of the patches around sites; sites whose patch leaves the raster have NaN."""
        x0, x1, y0, y1 = extent(box)
        _, h, w = self.stack.shape
        out = np.full((len(xy), encoder.features), np.nan)
        cols, rows = np.floor((xy[:, 0] - x0) / (x1 - x0) * w), np.floor((y1 - xy[:, 1]) / (y1 - y0) * h)
        half = self.size // 2
        ok = np.isfinite(cols) & np.isfinite(rows) & (rows >= half) & (rows + self.size - half <= h) & (cols >= half) & (cols + self.size - half <= w)
        if ok.any():
            out[ok] = encoder.embed(np.stack([self.patch(int(r), int(c)) for r, c in zip(rows[ok], cols[ok], strict=True)]))
        return out


def embed_cells(cells: DataFrame, encoder: Encoder, bands: list[str], size: int, stride: int) -> DataFrame:
    """row, col, embedding of the patches at every `stride` cells of a raster table (row, col, band, value).

    A patch's cells come together by an equi-join-free explode: a cell goes to the patches that it is in. Patches that
    lack cells are left out; gaps in the values are 0, as after scaling.
    """
    firsts = lambda c: F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - (size - 1)) / stride)).cast("int"), F.floor(F.col(c) / stride).cast("int"))
    placed = cells.withColumn("pr", F.explode(firsts("row"))).withColumn("pc", F.explode(firsts("col")))
    sent = cells.sparkSession.sparkContext.broadcast(encoder)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf.pr.iloc[0]) * stride, int(pdf.pc.iloc[0]) * stride
        if len(pdf) < size * size * len(bands):
            return pd.DataFrame({"row": [], "col": [], "embedding": []})
        x = np.zeros((1, len(bands), size, size))
        x[0, pdf.band.map({b: i for i, b in enumerate(bands)}), pdf.row - r0, pdf.col - c0] = pdf["value"].fillna(0)
        return pd.DataFrame({"row": [r0 + size // 2], "col": [c0 + size // 2], "embedding": [sent.value.embed(x)[0].tolist()]})

    return placed.groupBy("pr", "pc").applyInPandas(one, "row int, col int, embedding array<double>")


# weights


class WeightStore:
    """Published weights: entries of name, url and sha256; fetching is handed in and what comes is checked."""

    def __init__(self, entries: list[dict], fetch: Callable[[str], bytes]):
        self.entries, self.fetch, self.held = entries, fetch, {}

    def entry(self, name: str) -> dict:
        found = [e for e in self.entries if e["name"] == name]
        if len(found) != 1:
            raise ValueError(f"[WeightStore] {len(found)} entries named {name}; there are {', '.join(e['name'] for e in self.entries)}")
        return found[0]

    def download(self, name: str, overwrite: bool = False) -> bytes:
        entry = self.entry(name)
        if name not in self.held or overwrite:
            content = self.fetch(entry["url"])
            if hashlib.sha256(content).hexdigest() != entry["sha256"]:
                raise ValueError(f"[WeightStore] {name}: the content's hash is another one than the entry's")
            self.held[name] = content
        return self.held[name]

    def load(self, name: str, encoder: Encoder) -> Encoder:
        return encoder.load(self.download(name))
