"""A regression with a spatial process over any number of sites: each site is conditioned on a few near ones."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.functions.columns import finite
from loamwork.functions.storage import written
from loamwork.operators.neighbours import knn

#: Near sites that a site is conditioned on.
NEAR = 20
#: Shares of the nugget in a site's variance that are tried, and ranges as parts of the sites' spread.
NUGGETS = (0.02, 0.1, 0.25, 0.5, 0.8)
RANGES = tuple(round(0.05 + i * 0.95 / 14, 4) for i in range(15))
#: Inverse gamma prior of the variance.
SHAPE, SCALE = 2.0, 1.0
MAX_COLUMNS = 100


def _sites(df: DataFrame, key: str, x: str, y: str, regressors: list[str], outcome: str) -> DataFrame:
    if len(regressors) > MAX_COLUMNS:
        raise ValueError(f"[vecchia] {len(regressors)} regressors; at most {MAX_COLUMNS}")
    row = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in [*regressors, outcome]])
    return df.filter(finite(*[F.col(c).cast("double") for c in (x, y, *regressors, outcome)])).select(F.col(key).alias("s_"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"), row.alias("row_"))


def _with_near(sites: DataFrame, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """sites with near_: position and row of the sites that pairs (src, dst) name, nearest first."""
    there = known.select(F.col("s_").alias("dst"), F.struct("px", "py", "row_").alias("site"))
    near = pairs.join(there, "dst").groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("distance", "dst", "site"))), lambda e: e["site"]).alias("near_"))
    return sites.join(near, sites["s_"] == near["src"], "left").drop("src").withColumn("near_", F.coalesce("near_", F.array().cast("array<struct<px:double,py:double,row_:array<double>>>")))


def conditioned(sites: DataFrame, near: int = NEAR) -> DataFrame:
    """sites with the near ones that come before them in an order of the sites.

    The order is by a hash, in levels that double: coarse levels span the area, and each level finds its neighbours by
    two joins of cells. A site is conditioned on the nearest of the near sites of earlier levels and of those near ones
    of its own level that come before it. The first level, of about near + 1 sites, is conditioned on all before: with
    no more sites than that the factors are exact.
    """
    n = sites.count()
    u = (F.pmod(F.xxhash64("s_"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    first = (near + 1) / max(1, n)
    level = F.greatest(F.lit(0), F.ceil(F.log2(u / first))).cast("int")
    placed = written(sites.withColumns({"u_": u, "level_": level}))
    coarse = placed.filter("level_ = 0").select(F.col("s_").alias("dst"), F.col("u_").alias("du"), F.col("px").alias("dx"), F.col("py").alias("dy"))
    # about near + 1 rows, by the hash
    pairs = placed.filter("level_ = 0").join(F.broadcast(coarse), F.struct("du", "dst") < F.struct("u_", "s_"))
    pairs = pairs.select(F.col("s_").alias("src"), "dst", F.hypot(F.col("px") - F.col("dx"), F.col("py") - F.col("dy")).alias("distance"))
    for at in range(1, (placed.agg(F.max("level_").alias("m")).first().m or 0) + 1):
        these = placed.filter(F.col("level_") == at)
        if not these.isEmpty():
            earlier = knn(these, "px", "py", "s_", near, among=placed.filter(F.col("level_") < at)).select("src", "dst", "distance")
            order = these.select("s_", "u_")
            own = knn(these, "px", "py", "s_", near).select("src", "dst", "distance").join(order.withColumnsRenamed({"s_": "src", "u_": "u"}), "src").join(order.withColumnsRenamed({"s_": "dst", "u_": "du"}), "dst")
            both = earlier.unionByName(own.filter(F.struct("du", "dst") < F.struct("u", "src")).select("src", "dst", "distance"))
            nearest = both.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("distance", "dst"))).filter(F.col("rank") <= near)
            pairs = pairs.unionByName(nearest.drop("rank"))
    return _with_near(placed.select("s_", "px", "py", "row_"), pairs, placed)


def _weights(own: np.ndarray, near: np.ndarray, held: np.ndarray, phi: float, nugget: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch of sites: the weights of their near sites (batch x m) and what variance is left, as parts of a site's
    own. The nugget is a share of the variance; places that no site holds weigh nothing."""
    away = np.sqrt(((near[:, :, None] - near[:, None]) ** 2).sum(-1))
    both = held[:, :, None] & held[:, None]
    eye = np.eye(near.shape[1])
    r = np.where(both, (1 - nugget) * np.exp(-phi * away), 0) * (1 - eye) + eye * (1 + 1e-8)
    c = np.where(held, (1 - nugget) * np.exp(-phi * np.sqrt(((near - own[:, None]) ** 2).sum(-1))), 0)
    w = np.linalg.solve(r, c[..., None])[..., 0]
    return w, np.maximum(1 + 1e-8 - (w * c).sum(1), 1e-12)


def _arrays(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, ...]:
    m = max(1, max((len(v) for v in pdf["near_"]), default=0))
    near, rows, held = np.zeros((len(pdf), m, 2)), np.zeros((len(pdf), m, width)), np.zeros((len(pdf), m), bool)
    for i, sites in enumerate(pdf["near_"]):
        for j, s in enumerate(sites):
            near[i, j], rows[i, j], held[i, j] = (s["px"], s["py"]), s["row_"], True
    return pdf[["px", "py"]].to_numpy(float), np.array(pdf["row_"].tolist(), float).reshape(len(pdf), width), near, rows, held


@dataclass
class Fit:
    """The posterior on the grid of (phi, nugget): weights, and of each point the coefficients, their unit covariance and
    the variance's shape and scale."""

    grid: list[tuple[float, float]]
    weights: np.ndarray
    beta: np.ndarray
    unit: np.ndarray
    shape: float
    scale: np.ndarray
    value: np.ndarray

    @property
    def best(self) -> int:
        return int(np.argmax(self.value))

    def draws(self, n: int = 500, seed: int = 1) -> dict[str, np.ndarray]:
        """Draws of phi, beta, and the variances of field (s2) and nugget (t2)."""
        rng = np.random.default_rng(seed)
        at = rng.choice(len(self.grid), size=n, p=self.weights)
        s = self.scale[at] / rng.gamma(self.shape, size=n)
        beta = np.array([rng.multivariate_normal(self.beta[g], v * self.unit[g]) for g, v in zip(at, s, strict=True)])
        phi, nugget = np.array([self.grid[g] for g in at]).T
        return {"phi": phi, "beta": beta, "s2": s * (1 - nugget), "t2": s * nugget}


def fit(df: DataFrame, key: str, x: str, y: str, regressors: list[str], outcome: str, near: int = NEAR, ranges: tuple[float, ...] = RANGES, nuggets: tuple[float, ...] = NUGGETS) -> Fit:
    """outcome = X b + field + noise, the field exponential in distance, under a flat prior of b and an inverse gamma one
    of the variance; decay and nugget are on a grid.

    The near sites are found once. One pass makes all grid points' likelihoods: a site's residual after its near ones,
    from a small solve, is independent of all others, so that they are sums over sites of a few numbers, and the driver
    gets (columns)^2 of them for each point. Work and shuffles grow with the sites, not with their square. Sites with a
    missing value take no part; ids must tell sites apart.
    """
    sites = written(_sites(df, key, x, y, regressors, outcome))
    box = sites.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{t}{c}") for c in ("px", "py") for t, f in (("lo", F.min), ("hi", F.max))]).first()  # one row
    k = len(regressors) + 1
    if box.n < k + 5:
        raise ValueError(f"[vecchia] {box.n} complete sites for {k} coefficients")
    spread = float(np.hypot(box.hipx - box.lopx, box.hipy - box.lopy)) or 1.0
    grid = [(3 / (spread * r), t) for r in ranges for t in nuggets]
    width = k + 1

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((len(grid), width * width + 1))
        for whole in batches:
            for i in range(0, len(whole), 512):
                own, row, near_at, rows, there = _arrays(whole.iloc[i : i + 512], width)
                for g, (phi, nugget) in enumerate(grid):
                    w, left = _weights(own, near_at, there, phi, nugget)
                    z = (row - (w[..., None] * rows).sum(1)) / np.sqrt(left)[:, None]
                    held[g, :-1] += (z.T @ z).ravel()
                    held[g, -1] += np.log(left).sum()
        yield pd.DataFrame({"g": np.repeat(np.arange(len(grid)), held.shape[1]), "i": np.tile(np.arange(held.shape[1]), len(grid)), "v": held.ravel()})

    parts = conditioned(sites, near).mapInPandas(sums, "g int, i int, v double").groupBy("g", "i").agg(F.sum("v").alias("v"))
    total = np.zeros((len(grid), width * width + 1))
    for r in parts.collect():  # (columns)^2 rows for each point of the grid
        total[r.g, r.i] = r.v
    m, logdet = total[:, :-1].reshape(-1, width, width), total[:, -1]
    unit = np.linalg.inv(m[:, :k, :k])
    beta = (unit @ m[:, :k, k:])[..., 0]
    rss = np.maximum(m[:, k, k] - (beta * m[:, :k, k]).sum(1), 0)
    shape, scale = SHAPE + (box.n - k) / 2, SCALE + rss / 2
    value = -0.5 * logdet + 0.5 * np.linalg.slogdet(unit)[1] - shape * np.log(scale)
    weights = np.exp(value - value.max())
    return Fit(grid, weights / weights.sum(), beta, unit, shape, scale, value)


def predict(model: Fit, df: DataFrame, new: DataFrame, key: str, x: str, y: str, regressors: list[str], outcome: str, near: int = NEAR) -> DataFrame:
    """key, mean, sd of the outcome at new sites, from their nearest known ones, at the grid's best point."""
    known = _sites(df, key, x, y, regressors, outcome)
    asked = _sites(new.withColumn("none_", F.lit(0.0)), key, x, y, regressors, "none_")
    known, asked = written(known), written(asked)
    linked = _with_near(asked, knn(asked, "px", "py", "s_", near, among=known, same=True), known)
    phi, nugget = model.grid[model.best]
    beta, variance, width = model.beta[model.best], model.scale[model.best] / (model.shape - 1), len(regressors) + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                own, row, near_at, rows, there = _arrays(pdf, width)
                w, left = _weights(own, near_at, there, phi, nugget)
                off = np.where(there, rows[:, :, -1] - rows[:, :, :-1] @ beta, 0)
                yield pd.DataFrame({"s_": pdf["s_"], "mean": row[:, :-1] @ beta + (w * off).sum(1), "sd": np.sqrt(variance * left)})

    return linked.mapInPandas(run, f"s_ {dict(linked.dtypes)['s_']}, mean double, sd double").withColumnRenamed("s_", key)
