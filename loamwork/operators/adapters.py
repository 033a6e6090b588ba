"""One shape for every model's uncertainty: draws with their kind, units and method, and what becomes one."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import singledispatch

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.operators import posterior as P
from loamwork.operators.active import ActiveModel, quantile_draws
from loamwork.operators.kernels import CircuitRidge

KINDS = ("scalar", "point", "profile", "map", "trajectory")


@dataclass
class Posterior:
    """Draws (query_id, draw_id, value). aleatoric is the deviation of the noise, if the draws are without it."""

    draws: DataFrame
    kind: str = "point"
    method: str = "draws"
    units: str | None = None
    aleatoric: float = 0.0
    metadata: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"[Posterior] kind is one of {', '.join(KINDS)}")
        missing = {"query_id", "draw_id", "value"} - set(self.draws.columns)
        if missing:
            raise ValueError(f"[Posterior] draws lack {', '.join(sorted(missing))}")

    def summary(self, probs: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
        """Mean, deviation, quantiles, and the deviation's two parts, of each query."""
        return P.summary(self.draws, probs).join(P.split_variance(self.draws, self.aleatoric).withColumn("aleatoric_sd", F.lit(self.aleatoric)), "query_id")

    def calibrate(self, truth: DataFrame, levels: list[float] = P.LEVELS) -> dict[str, DataFrame]:
        """Scores by query and coverage by level against truth (query_id, observed)."""
        coverage = P.interval_coverage(self.draws, truth, levels)
        means = self.draws.groupBy("query_id").agg(F.avg("value").alias("mean")).join(truth, "query_id")
        rmse = means.agg(F.sqrt(F.avg((F.col("mean") - F.col("observed")) ** 2)).alias("point_rmse"))
        return {"crps": P.crps(self.draws, truth), "coverage": coverage, "reliability": P.reliability(coverage), "point_rmse": rmse}

    def overview(self, probs: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
        """name, least, median, most over the queries of mean, deviation and each quantile."""
        names = ["mean", "sd", *map(P.quantile_name, probs)]
        long = P.summary(self.draws, probs).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in names])))
        return long.groupBy("name").agg(F.min("v").alias("least"), F.median("v").alias("median"), F.max("v").alias("most"))


@dataclass
class Gaussian:
    """An estimate and its standard error, such as an effect's."""

    mean: float
    sd: float


def effect_gaussian(fit: dict) -> Gaussian:
    """Of an effect: its standard error, or else the width of its 95 % interval."""
    mean = fit.get("effect", fit.get("adjusted"))
    if fit.get("se") is not None:
        return Gaussian(mean, fit["se"])
    low, high = fit["interval"]
    return Gaussian(mean, (high - low) / (2 * 1.96))


def from_matrix(spark: SparkSession, draws: np.ndarray, **about) -> Posterior:
    """Draws as an array: (draw, query...); queries are numbered in the array's order."""
    flat = np.asarray(draws, float).reshape(len(draws), -1)
    rows = [(int(q), int(d), float(flat[d, q])) for d in range(flat.shape[0]) for q in range(flat.shape[1])]
    return Posterior(spark.createDataFrame(rows, "query_id long, draw_id int, value double"), **about)


@singledispatch
def as_posterior(x, spark: SparkSession | None = None, **about) -> Posterior:
    """What x says as a Posterior. Arrays and lists are draws; models have adapters of their own."""
    if isinstance(x, dict) and ("effect" in x or "adjusted" in x):
        return as_posterior(effect_gaussian(x), spark, **about)
    if isinstance(x, dict) and {"beta", "s2", "t2", "w"} <= set(x):
        return spatial_posterior(x, spark, **about)
    raise TypeError(f"[as_posterior] no adapter for {type(x).__name__}")


@as_posterior.register
def _(x: Posterior, spark: SparkSession | None = None, **about) -> Posterior:
    return x


@as_posterior.register
def _(x: DataFrame, spark: SparkSession | None = None, **about) -> Posterior:
    return Posterior(x, **about)


@as_posterior.register
def _(x: np.ndarray, spark: SparkSession | None = None, **about) -> Posterior:
    return from_matrix(spark, x if x.ndim > 1 else x[:, None], **({"kind": "scalar"} if x.ndim == 1 else {}) | about)


@as_posterior.register
def _(x: list, spark: SparkSession | None = None, **about) -> Posterior:
    return as_posterior(np.asarray(x, float), spark, **about)


@as_posterior.register
def _(x: Gaussian, spark: SparkSession | None = None, draws: int = 500, seed: int = 1, **about) -> Posterior:
    rows = spark.createDataFrame([(0, x.mean, x.sd)], "id long, mean double, sd double")
    return Posterior(P.from_gaussian(rows, "id", "mean", "sd", draws, seed), **{"kind": "scalar", "method": "gaussian"} | about)


@as_posterior.register
def _(x: ActiveModel, spark: SparkSession | None = None, rows: DataFrame | None = None, key: str = "id", grid: int = 99, **about) -> Posterior:
    if rows is None:
        raise ValueError("[as_posterior] an active model needs the rows to answer for\nHint: as_posterior(model, rows=..., key=...)")
    return Posterior(quantile_draws(x, rows, key, grid), **{"method": "quantile forest"} | about)


@as_posterior.register
def _(x: CircuitRidge, spark: SparkSession | None = None, new: np.ndarray | None = None, draws: int = 500, seed: int = 1, **about) -> Posterior:
    if new is None:
        raise ValueError("[as_posterior] a kernel ridge needs the rows to answer for\nHint: as_posterior(model, spark, new=...)")
    return from_matrix(spark, x.draws(new, draws, seed), **{"method": "kernel ridge", "aleatoric": math.sqrt(x.noise)} | about)


def spatial_posterior(fit: dict, spark: SparkSession, x: np.ndarray | None = None, place: np.ndarray | None = None, **about) -> Posterior:
    """A spatial model's fitted values, or its predictions at new sites."""
    from loamwork.operators.spatial import predict

    if x is not None:
        return from_matrix(spark, predict(fit, x, place), **{"method": "gibbs"} | about)
    return from_matrix(spark, fit["fitted"], **{"method": "gibbs", "aleatoric": float(np.sqrt(fit["t2"].mean()))} | about)


def curves_posterior(curves: DataFrame, key: str, name: str, **about) -> Posterior:
    """Of curves (key, depth, draw_id, value), as ode_ensemble() and bayes_curves() give them, one profile's: a query is
    a depth, numbered in their order."""
    depths = [r.depth for r in curves.filter((F.col(key) == name) & F.col("depth").isNotNull()).select("depth").distinct().orderBy("depth").collect()]
    number = F.array_position(F.array(*map(F.lit, depths)), F.col("depth")) - 1
    return Posterior(curves.filter((F.col(key) == name) & F.col("value").isNotNull()).select(number.cast("long").alias("query_id"), "draw_id", "value"), **{"kind": "profile", "method": "curves"} | about)


def grid_posterior(members: DataFrame, width: int, t: int | None = None, **about) -> Posterior:
    """Of an ensemble of grids (member, row, col, value and perhaps t) the map at one step; a query is a cell."""
    rows = members if t is None or "t" not in members.columns else members.filter(F.col("t") == t)
    return Posterior(rows.select((F.col("row") * width + F.col("col")).cast("long").alias("query_id"), F.col("member").alias("draw_id"), "value"), **{"kind": "map", "method": "ensemble"} | about)
