"""The active-learning model: a quantile forest with its labelled rows, queries for what to label next, its history."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions.columns import check_columns
from loamwork.operators.forest import QuantileForest
from loamwork.operators.selection import complete, greedy_batch, joint_variance_batch
from loamwork.operators.spatial import site_variance


def check_coords(df: DataFrame, coords: list[str]) -> None:
    """Exactly two coordinate columns, both there."""
    if len(coords) != 2:
        raise ValueError(f"[check_coords] two coordinate columns are needed, not {len(coords)}\nHint: give [x, y]")
    check_columns(df, coords, "check_coords")


@dataclass
class ActiveModel:
    """Labelled rows, the forest fitted on them, and one entry of history for each fit."""

    labelled: DataFrame
    target: str
    names: list[str]
    forest: QuantileForest
    config: dict
    coords: list[str] | None = None
    history: list[dict] = field(default_factory=list)

    def history_table(self) -> DataFrame:
        rows = [(h["iteration"], h["n_labelled"], h["rmse"], h["uncertainty"]) for h in self.history]
        return self.labelled.sparkSession.createDataFrame(rows, "iteration int, n_labelled long, rmse double, mean_uncertainty double")


def held_out_rmse(rows: DataFrame, target: str, names: list[str], folds: int = 2, **config) -> float:
    """Root mean square error on rows that their forest hasn't seen: folds by a hash of the row.

    The library's forests tell no out-of-bag error; each fold is one more fit.
    """
    placed = rows.withColumn("fold_", F.pmod(F.xxhash64(target, *names), F.lit(folds)))
    total, n = 0.0, 0
    for k in range(folds):
        seen, unseen = placed.filter(F.col("fold_") != k), placed.filter(F.col("fold_") == k).withColumn("key_", F.monotonically_increasing_id())
        if seen.isEmpty() or unseen.isEmpty():
            continue
        scored = QuantileForest(seen, target, names, **config).model
        got = scored.transform(QuantileForest.assembled(unseen, names)).agg(F.sum((F.col("prediction") - F.col(target)) ** 2).alias("s"), F.count(F.lit(1)).alias("n")).first()
        total, n = total + (got.s or 0.0), n + got.n
    return float(np.sqrt(total / n)) if n else float("nan")


def fit(labelled: DataFrame, target: str, names: list[str], coords: list[str] | None = None, history: list[dict] | None = None, **config) -> ActiveModel:
    """A forest on the complete rows, and a line of history: rows, held-out error, mean width of the 0.1 to 0.9 range."""
    check_columns(labelled, [target, *names], "fit")
    if coords:
        check_coords(labelled, coords)
    rows = complete(labelled, [target, *names])
    config = {"trees": 50, "depth": 8, "seed": 1} | config
    forest = QuantileForest(rows, target, names, **config)
    width = forest.quantiles(rows.withColumn("key_", F.monotonically_increasing_id()), "key_", [0.1, 0.9]).agg(F.avg(F.col("quantiles")[1] - F.col("quantiles")[0]).alias("w")).first().w
    line = {"iteration": len(history or []), "n_labelled": rows.count(), "rmse": held_out_rmse(rows, target, names, **config), "uncertainty": width}
    return ActiveModel(rows, target, names, forest, config, coords, [*(history or []), line])


def update(model: ActiveModel, new: DataFrame) -> ActiveModel:
    """The model fitted again with new labelled rows."""
    check_columns(new, [model.target, *model.names], "update")
    return fit(model.labelled.unionByName(new.select(*model.labelled.columns)), model.target, model.names, model.coords, model.history, **model.config)


def query(model: ActiveModel, pool: DataFrame, key: str, n: int = 5, strategy: str = "hybrid", alpha: float = 0.7, quantiles: tuple[float, float] = (0.1, 0.9), cost: str | None = None, cost_weight: float = 0.3, gate: Callable[[Column], Column] | None = None, base: tuple[float, float] | None = None) -> list:
    """Keys of the n rows to label next. Uncertainty is the width between two quantiles; gate(prediction) tells which
    rows may be picked at all. The cost is a column, or the way from a base, for which the model knows the coordinates."""
    rows = complete(pool, model.names)
    if base is not None and cost is None:
        check_coords(pool, model.coords or [])
        x, y = model.coords
        rows, cost = rows.withColumn("cost_", F.sqrt((F.col(x) - base[0]) ** 2 + (F.col(y) - base[1]) ** 2)), "cost_"
    if strategy == "cost" and cost is None:
        raise ValueError("[query] the strategy 'cost' needs a cost column or a base")
    told = model.forest.quantiles(rows, key, list(quantiles))
    scored = rows.join(told.select(key, F.col("mean").alias("mean_"), (F.col("quantiles")[1] - F.col("quantiles")[0]).alias("width_")), key)
    if gate is not None:
        scored = scored.filter(gate(F.col("mean_")))
    return greedy_batch(scored, key, model.names, "width_", n, model.labelled, strategy, alpha, cost, cost_weight)


def tree_predictions(model: ActiveModel, pool: DataFrame, key: str) -> DataFrame:
    """key, trees: the leaves' means of each row by tree, from a join of rows and leaves."""
    means = model.forest.leaves.groupBy("tree", "leaf").agg((F.sum(F.col("y_") * F.col("weight")) / F.sum("weight")).alias("m"))
    rows = model.forest._leaves(complete(pool, model.names), [key]).join(means, ["tree", "leaf"])
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("tree", "m"))), lambda s: s["m"]).alias("trees"))


def noise_variance(model: ActiveModel) -> float:
    """Variance of the labels around the forest's answers."""
    scored = model.forest.model.transform(QuantileForest.assembled(model.labelled, model.names))
    return float(scored.agg(F.var_samp(F.col(model.target) - F.col("prediction")).alias("v")).first().v or 0.0)


def query_joint_variance(model: ActiveModel, pool: DataFrame, key: str, n: int = 5, noise: float | None = None, gate: Callable[[Column], Column] | None = None) -> list:
    """Keys of n rows of the greatest joint variance over the trees: each the most uncertain given those before it."""
    if gate is not None:
        scored = model.forest.model.transform(QuantileForest.assembled(complete(pool, model.names), model.names))
        pool = pool.join(scored.filter(gate(F.col("prediction"))).select(key), key, "left_semi")
    return joint_variance_batch(tree_predictions(model, pool, key), key, "trees", noise_variance(model) if noise is None else noise, n)


def loop(labelled: DataFrame, pool: DataFrame, target: str, names: list[str], key: str, oracle: Callable[[DataFrame], DataFrame], budget: int = 30, batch: int = 5, stop_rmse: float | None = None, progress: Callable[[int, int], None] | None = None, **query_args) -> ActiveModel:
    """Ask, label, fit again until the budget is spent, the pool is empty or the held-out error is small enough."""
    fit_args = {k: query_args.pop(k) for k in ("trees", "depth", "seed") if k in query_args}
    model = fit(labelled, target, names, **fit_args)
    spent = 0
    while spent < budget and (stop_rmse is None or not model.history[-1]["rmse"] <= stop_rmse):
        keys = query(model, pool, key, min(batch, budget - spent), **query_args)
        if not keys:
            break
        rows = pool.filter(F.col(key).isin(keys))
        model, pool, spent = update(model, oracle(rows)), pool.filter(~F.col(key).isin(keys)), spent + len(keys)
        if progress is not None:
            progress(spent, budget)
    return model


def quantile_draws(model: ActiveModel, rows: DataFrame, key: str, grid: int = 99) -> DataFrame:
    """query_id, draw_id, value: the quantiles i / (grid + 1) of each row as draws."""
    told = model.forest.quantiles(rows, key, [i / (grid + 1) for i in range(1, grid + 1)])
    return told.select(F.col(key).alias("query_id"), F.posexplode("quantiles").alias("draw_id", "value"))


# queries of other models


def query_operator(net, ode, covariates: np.ndarray, depths: np.ndarray, n: int = 5, perturbed: int = 20, sd: float = 0.1, seed: int = 1) -> list[tuple[int, float]]:
    """Rows and scores of the n rows where an operator net and a differential equation disagree most, for the operator's
    own spread under small changes of the covariates."""
    apart = np.abs(net.predict(covariates) - np.atleast_2d(ode.predict(depths, covariates if ode.c_mean is not None else None))).mean(axis=1)
    rng = np.random.default_rng(seed)
    scale = sd * np.maximum(covariates.std(axis=0), 1e-9)
    spread = np.stack([net.predict(covariates + scale * rng.normal(size=covariates.shape)) for _ in range(perturbed)]).std(axis=0, ddof=1).mean(axis=1)
    score = apart / np.maximum(spread, 1e-6)
    return [(int(i), float(score[i])) for i in np.argsort(-score, kind="stable")[:n]]


def query_samples(samples: DataFrame, n: int = 10, rule: str = "sd", among: DataFrame | None = None) -> DataFrame:
    """row, col, score of the cells that differ most between samples (sample, row, col, value) of a generator: their
    deviation, or that times the mean's size."""
    cells = samples.groupBy("row", "col").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    scored = cells.withColumn("score", F.col("sd") if rule == "sd" else F.col("sd") * F.abs("mean"))
    if among is not None:
        scored = scored.join(among.select("row", "col").distinct(), ["row", "col"], "left_semi")
    return scored.orderBy(F.col("score").desc_nulls_last(), "row", "col").limit(n).select("row", "col", "score")


def query_sites(fit_: dict, place: np.ndarray, n: int = 5) -> list[tuple[int, float]]:
    """Sites and mean predictive variances, greatest first, of a spatial model's draws."""
    v = site_variance(fit_, place)
    return [(int(i), float(v[i])) for i in np.argsort(-v, kind="stable")[:n]]
